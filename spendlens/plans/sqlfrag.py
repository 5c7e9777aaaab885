"""DuckDB SQL fragments used by the oracle queries (text built from the same
fixed tables the Spark operators take as parameters)."""

from __future__ import annotations

from .. import constants as K
from ..sources.tables import TXN_CTE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def std_text(x: str) -> str:
    return (r"trim(regexp_replace(regexp_replace(lower(" + x + r"), '[^\p{L}\p{N}_\s/-]', ' ', 'g'),"
            r" '\s+', ' ', 'g'))")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def merchant(x: str) -> str:
    d = f"upper({x})"
    skip = "[" + ", ".join(q(w) for w in K.MERCHANT_SKIP_WORDS) + "]"
    first = (f"list_filter(list_transform(string_split_regex({d}, '\\s+'), "
             f"lambda w: regexp_replace(w, '[^A-Z]', '', 'g')), "
             f"lambda w: length(w) > 2 AND NOT list_contains({skip}, w))[1]")
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    return (f"lower(CASE WHEN {x} IS NULL THEN 'UNKNOWN' "
            f"WHEN regexp_matches({d}, {q(K.UPI_PATTERN)}) THEN regexp_replace(regexp_extract({d}, "
            f"{q(K.UPI_PATTERN)}, 1), {q(K.UPI_SUFFIX_PATTERN)}, '') "
            f"WHEN regexp_matches({d}, {q(K.POS_PATTERN)}) THEN "
            + strip.format(f"regexp_extract({d}, {q(K.POS_PATTERN)}, 2)") + " "
            f"WHEN regexp_matches({d}, {q(K.BANK_TRANSFER_PATTERN)}) THEN "
            + strip.format(f"regexp_extract({d}, {q(K.BANK_TRANSFER_PATTERN)}, 1)") + " "
            f"ELSE coalesce({first}, 'UNKNOWN') END)")


def mode(x: str, strict: bool = False) -> str:
    parts = [f"CASE WHEN {x} IS NULL THEN 'unknown'"]
    for key, label in K.TRANSACTION_MODES:
        needle = key if strict else key.upper()
        parts.append(f"WHEN contains(upper({x}), {q(needle)}) THEN {q(label)}")
    return " ".join(parts) + " ELSE 'other' END"


def scores(low: str, table: dict) -> dict[str, str]:
    t = f"coalesce({low}, '')"
    return {cat: "(" + " + ".join(f"CAST(contains({t}, {q(k)}) AS INTEGER)" for k in kws) + ")"
            for cat, kws in table.items()}


def best(sc: dict[str, str]) -> tuple[str, str]:
    g = "greatest(" + ", ".join(sc.values()) + ")"
    chain = " ".join(f"WHEN {s} = {g} THEN {q(c)}" for c, s in sc.items())
    return f"CASE WHEN {g} >= 1 THEN CASE {chain} END END", g


def relabel(desc: str, cat: str, table: dict = K.CLEANER_KEYWORDS) -> str:
    low = f"lower({desc})"
    b, g = best(scores(low, table))
    n = word_count(f"coalesce({low}, 'nan')")
    return (f"CASE WHEN ({b}) IS NOT NULL AND NOT (lower({cat}) IS NOT DISTINCT FROM ({b})) "
            f"AND ({g} >= 2 OR ({g} = 1 AND {n} <= 3)) THEN ({b}) ELSE {cat} END")


def py_fixed(x: str, digits: int) -> str:
    """DuckDB printf rounds the exact binary value half-even, like Python."""
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def values(rows, names: str, alias: str = "t") -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(str(v))
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({names})"


BENCH_SQL = values([(c, i, w) for c, (i, w) in K.BENCHMARKS.items()],
                   "bcat, ideal_pct, warning_pct", "b")
TIPS_SQL = values(list(K.CATEGORY_TIPS.items()), "tcat, tip", "tp")
MERCHANT_MAP_SQL = values(list(K.MERCHANT_CATEGORY.items()), "mname, m_category", "mm")

# txn plus the cleaning projections every insight query starts from.
TXN_M = TXN_CTE + (", txm AS (SELECT *, " + merchant("description") + " AS merchant FROM txn)\n")
