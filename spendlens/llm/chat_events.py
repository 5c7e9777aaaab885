"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` (a turn with its text),
``delta`` (text streamed to the end of a turn), ``edit`` (the turn's text is
replaced) and ``regenerate`` (its text is dropped and streamed anew).  The fold
works per turn, not per conversation: of each (conversation, turn) the events
since the last one that sets the text count, in order of their sequence
number, so a conversation with a third of all events is split over all tasks
and only one turn's own text is put together in one place.

Rendering is a projection of one turn: ``<|im_start|>role\\ntext<|im_end|>\\n``
with the character span of the text under the loss mask (assistant turns).  A
control string inside a text or role (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) gets a backslash after its first character, one more if it has
some already, so reading back is exact.

``conversation_digests`` reads the rendered turns back in order.  A digest of a
whole conversation is sequential, so its turns pass one task as a sorted
stream; the task keeps one hash state and never the conversation.

Edge cases: NULL text and role count as empty; a turn that only has deltas
starts empty; events with equal sequence numbers apply in order of kind, then
text; repeated rows of a table of turns are turns of their own; extra columns
are ignored; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, texts

# The template and the control strings it guards against.
OPEN, CLOSE, LOSS_ROLES = "<|im_start|>", "<|im_end|>\n", ("assistant",)
CONTROL = r"([<\[])(\\*)(?=\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])"

SETS_TEXT = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\")


def fold(events: DataFrame) -> DataFrame:
    """Final turns of a log (conv_id, msg, seq, kind, role, text): conv_id, msg,
    first sequence number, role, text."""
    kind = F.col("kind")
    set_at = F.max(F.when(kind.isin(*SETS_TEXT), F.col("seq"))).over(
        Window.partitionBy("conv_id", "msg"))
    live = events.withColumn("_set", set_at).withColumn(
        "_live", F.col("_set").isNull() | (F.col("seq") >= F.col("_set")))
    text = F.when(F.col("_live") & (kind != "regenerate"), F.coalesce("text", F.lit("")))
    piece = F.struct("seq", F.when(kind == "delta", 1).otherwise(0).alias("late"),
                     text.alias("text"))
    pieces = F.array_sort(F.collect_list(F.when(text.isNotNull(), piece)))
    role = F.min_by("role", F.struct("seq", "kind"))
    return live.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("seq"), F.coalesce(role, F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def render(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Add ``formatted`` and the span [loss_start, loss_end) of its characters
    under the loss mask (NULL where none is)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    safe_role = F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")),
                          F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), safe_role, F.lit("\n"))
    body = escape(text)
    learned = role.isin(*loss_roles)
    return turns.withColumns({
        "formatted": F.concat(head, body, F.lit(CLOSE)),
        "loss_start": F.when(learned, F.length(head)),
        "loss_end": F.when(learned, F.length(head) + F.length(body))})


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + r"\Z", re.S)
_ESCAPED = re.compile(ESCAPED)
_ROLE_ESCAPE = re.compile(r"\\(.)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    role, body = _TURN.match(formatted).groups()
    role = _ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)
    return unescape(role), unescape(body)


DIGEST_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered turns: counts and digests
    of the turns and of the text under the loss mask."""
    bound_batches(rendered.sparkSession, 2000)
    ordered = rendered.select(
        "conv_id", "seq", "msg", "formatted", "loss_start", "loss_end").repartition(
        "conv_id").sortWithinPartitions("conv_id", "seq", "msg")
    arrow = to_arrow_schema(DIGEST_SCHEMA)

    def digest(batches):
        key, state = None, None

        def row():
            return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def rows_of(done):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done), arrow, strict=True)],
                schema=arrow)

        for b in batches:
            done = []
            for conv, text, a, z in zip(
                    b.column(0).to_pylist(), texts(b.column(3)), b.column(4).to_pylist(),
                    b.column(5).to_pylist(), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                if a is not None:
                    learned = unescape(text[a:z])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield rows_of(done)
        if state is not None:
            yield rows_of([row()])

    return ordered.mapInArrow(digest, DIGEST_SCHEMA)


def turn_events(turns: DataFrame) -> DataFrame:
    """Log of a table of turns (conv_id, turn, role, text): a user or system row
    is one ``message``; an assistant row opens empty and is streamed in two
    deltas.  Rows with equal turn numbers stay apart, in order of role and text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
                        role.alias("role"), text.alias("text")).withColumn(
        "msg", F.struct("turn", F.row_number().over(same_turn).alias("copy")))
    half = F.floor(F.length("text") / 2).cast("int")
    opened = F.struct(F.lit("message").alias("kind"), F.lit("").alias("piece"), F.lit(0).alias("at"))
    streamed = [F.struct(F.lit("delta").alias("kind"), p.alias("piece"), F.lit(k).alias("at"))
                for k, p in ((1, F.substring("text", F.lit(1), half)),
                             (2, F.substring("text", half + 1, F.length("text"))))]
    whole = F.struct(F.lit("message").alias("kind"), F.col("text").alias("piece"),
                     F.lit(0).alias("at"))
    events = F.when(F.col("role") == "assistant", F.array(opened, *streamed)).otherwise(
        F.array(whole))
    return rows.withColumn("e", F.explode(events)).select(
        "conv_id", "msg", (F.col("turn") * 4 + F.col("e.at")).alias("seq"),
        F.col("e.kind").alias("kind"), "role", F.col("e.piece").alias("text"))
