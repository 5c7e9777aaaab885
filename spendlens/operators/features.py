"""Transaction feature operators.

Row-wise features are projections.  Fitted values (median / q75, mean and
population sd, min / max, top merchants) come from ONE aggregate over the
training rows and are then applied as literals, so scoring uses the values
seen in training (no refit on the scoring batch).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keywords import any_keyword, keyword_occurrences
from ..functions.text import as_python_text, avg_word_length, char_count, word_count

NON_FEATURE_COLUMNS = ("description", "amount", "category", "amount_category")


# ------------------------------------------------------------------ F1-F5
def text_features(df: DataFrame, text_col: str = "description",
                  keywords: dict = K.FEATURE_KEYWORDS) -> DataFrame:
    """word_count, char_count, avg_word_length, then per category
    ``has_<cat>_keyword`` (0/1) and ``<cat>_keyword_count`` (non-overlapping
    occurrences summed over the keywords).  A NULL text reads as ``nan``."""
    t = as_python_text(F.col(text_col))
    d = df.withColumn("__t", t).withColumn("__low", F.lower(F.col("__t")))
    cols = {"word_count": word_count(F.col("__t")),
            "char_count": char_count(F.col("__t")),
            "avg_word_length": avg_word_length(F.col("__t")).cast("double")}
    low = F.col("__low")
    for cat, kws in keywords.items():
        cols[f"has_{cat}_keyword"] = any_keyword(low, kws)
        cols[f"{cat}_keyword_count"] = keyword_occurrences(low, kws)
    return d.withColumns(cols).drop("__t", "__low")


# ------------------------------------------------------------------ fitted stats
@dataclass
class AmountStats:
    """Fitted amount statistics.  ``relative_error=0`` gives exact linearly
    interpolated quantiles (``exact_quantiles``: bounded memory per task);
    >0 uses one ``percentile_approx``."""
    median: float | None = None
    q75: float | None = None
    mean: float | None = None
    std_pop: float | None = None
    min: float | None = None
    max: float | None = None
    top_merchants: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, amount_col: str = "amount", relative_error: float = 0.0,
            merchant_col: str | None = None, top_k: int = 15) -> "AmountStats":
        from .quantiles import exact_quantiles
        x = F.col(amount_col).cast("double")
        r = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
                   F.min(x).alias("mn"), F.max(x).alias("mx")).first()
        if relative_error > 0:
            qr = df.agg(F.percentile_approx(x, [0.5, 0.75], int(1 / relative_error))
                        .alias("q")).first()["q"]
        else:
            row = exact_quantiles(df, amount_col, [0.5, 0.75]).first()
            qr = [row["q0"], row["q1"]] if row else None
        top = []
        if merchant_col and merchant_col in df.columns:
            top = [row[0] for row in top_values(df, merchant_col, top_k).collect()]
        qs = qr or [None, None]
        return cls(qs[0], qs[1], r["mean"], r["sd"], r["mn"], r["mx"], top)

    def to_dict(self) -> dict:
        return asdict(self)


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-NULL values (ties: value order): a grouped
    count then a top-k, never a collect of the rows."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(k).select(col, "n"))


# ------------------------------------------------------------------ F6-F11
def log_amount(c: F.Column) -> F.Column:
    """ln(1 + |x|); NULL -> 0."""
    return F.coalesce(F.log1p(F.abs(c.cast("double"))), F.lit(0.0))


def amount_category(c: F.Column, median: float, q75: float) -> F.Column:
    """small (<= median), medium (<= q75), else large (NULL -> large)."""
    x = c.cast("double")
    return (F.when(x <= F.lit(median), F.lit("small")).when(x <= F.lit(q75), F.lit("medium"))
            .otherwise(F.lit("large")))


def amount_dummies(cat: F.Column) -> dict[str, F.Column]:
    """F8: one-hot of the amount category (all three levels, in name order)."""
    return {f"amount_{lvl}": (cat == lvl).cast("int") for lvl in ("large", "medium", "small")}


def standard_scale(c: F.Column, mean: float, std_pop: float) -> F.Column:
    """(x - mean) / population sd; sd 0 -> divide by 1."""
    sd = std_pop if std_pop else 1.0
    return (c.cast("double") - F.lit(mean)) / F.lit(sd)


def minmax_scale(c: F.Column, lo: float, hi: float) -> F.Column:
    """(x - min) / (max - min); constant column -> 0."""
    if hi is None or lo is None or hi <= lo:
        return F.lit(0.0)
    return (c.cast("double") - F.lit(lo)) / F.lit(hi - lo)


def fixed_bins(c: F.Column, edges=K.AMOUNT_BIN_EDGES, names=K.AMOUNT_BIN_NAMES) -> dict:
    """one-hot of <100, <500, <1000, else (NULL counts as 0)."""
    x = F.coalesce(c.cast("double"), F.lit(0.0))
    out, lower = {}, None
    for i, name in enumerate(names):
        hit = F.lit(True) if i == len(edges) else (x < F.lit(edges[i]))
        if lower is not None:
            hit = hit & (x >= F.lit(lower))
        out[name] = hit.cast("int")
        lower = edges[i] if i < len(edges) else None
    return out


def merchant_onehot(c: F.Column, merchants: list[str]) -> dict[str, F.Column]:
    """indicator per fitted top merchant."""
    return {f"merchant_{m}": (c == F.lit(m)).cast("int").alias(f"merchant_{m}")
            for m in merchants}


# ------------------------------------------------------------------ F17, F18
def engineer_features(df: DataFrame, stats: AmountStats, text_col: str = "description",
                      amount_col: str = "amount") -> DataFrame:
    """24 numeric features (3 text stats, 8 x (flag, count), log amount,
    3 amount dummies, standard-scaled amount) plus the ``amount_category`` text."""
    d = text_features(df, text_col)
    a = F.col(amount_col)
    d = d.withColumn("log_amount", log_amount(a))
    d = d.withColumn("amount_category", amount_category(a, stats.median, stats.q75))
    d = d.withColumns(amount_dummies(F.col("amount_category")))
    return d.withColumn("amount_scaled", standard_scale(a, stats.mean, stats.std_pop))


def feature_columns(df: DataFrame, exclude=NON_FEATURE_COLUMNS) -> list[str]:
    """numeric columns other than the raw inputs and the label (string
    columns such as merchant or transaction_mode are never features)."""
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields
            if f.name not in exclude and isinstance(f.dataType, NumericType)
            and not f.name.endswith("_id") and f.name != "label"]


def compact_amount_features(df: DataFrame, stats: AmountStats,
                            amount_col: str = "amount") -> DataFrame:
    """The amount block of F16: min-max scaled, log, four fixed bins."""
    a = F.coalesce(F.col(amount_col).cast("double"), F.lit(0.0))
    cols = {"amount_scaled": minmax_scale(a, stats.min, stats.max), "log_amount": log_amount(a)}
    cols.update(fixed_bins(a))
    return df.withColumns(cols)
