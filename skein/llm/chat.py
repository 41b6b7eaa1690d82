"""Chat formatting by token-level assembly.

Roles and texts are encoded as separate segments; reserved ids above the vocabulary mark turns, so no text can produce
them. Loss masks are spans from prefix sums over segment lengths. For the text form, control strings inside segments are
escaped with a backslash, which can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lists, release, table

TOKENIZER = "byte_bpe_50k.json"
#: Reserved ids, above the tokenizer's 50,257, and their text form.
OPEN, MIDDLE, CLOSE = 50300, 50301, 50302
CONTROL = {OPEN: "### ", MIDDLE: ": ", CLOSE: "</turn>\n"}
#: Strings that are escaped in roles and texts: what could be read as a turn's start or end.
GUARDED = ("###", "</turn>", "\\")
LOSS_ROLE = "assistant"
#: Characters that are encoded at once, about.
CHARS = 1_000_000
_ESCAPE = re.compile("|".join(re.escape(x) for x in GUARDED))
_ROLE_ESCAPE = re.compile("|".join(re.escape(x) for x in (*GUARDED, ":")))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_encoders: dict[str, object] = {}


def escape(text: str, role: bool = False) -> str:
    """A backslash before each control string and each backslash; in a role also before a colon."""
    return (_ROLE_ESCAPE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def encoder(name: str):
    if name not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        inner.encode_special_tokens = True  # their strings in a text are ordinary text
        _encoders[name] = inner
    return _encoders[name]


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: str = TOKENIZER) -> DataFrame:
    """One row per turn: conv, turn, nth (0, 1, ... in the conversation), ids (its token ids), start (of its ids in the
    conversation), loss_from and loss_to (span of the conversation's ids under the loss mask; equal if none).

    A turn's ids are OPEN, the role's, MIDDLE, the escaped text's, CLOSE. Rows are ordered by turn (null first), ties by
    role, then text; null roles and texts are empty; a null conversation id is a conversation. Repeated rows are turns of
    their own; no rows give none. Only the role `assistant` is under the mask, and only its text. Other columns are not
    looked at. At most about CHARS characters are encoded at once, a longer text alone.

    Turns are encoded where they lie, then range-partitioned by conversation and turn; running sums of segment lengths go
    over each partition's part of a conversation, and one row a part says what comes before it. So a conversation with a
    third of all turns is summed by many tasks.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark)
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in _character_runs(b, "text", CHARS):
                roles, texts = some.column("role").to_pylist(), some.column("text").to_pylist()
                got = encoder(tokens).encode_batch([escape(r, True) for r in roles] + [escape(t) for t in texts], add_special_tokens=False)
                ids, head, long = [], [], []
                for r, t in zip(got[: len(roles)], got[len(roles) :]):
                    ids.append(np.array([OPEN, *r.ids, MIDDLE, *t.ids, CLOSE], np.int32))
                    head.append(len(r.ids) + 2)
                    long.append(len(ids[-1]))
                order = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([some.column("conv"), some.column("turn"), some.column("role"), pa.array(order, pa.string()), lists(ids, pa.int32()), pa.array(head, pa.int64()), pa.array(long, pa.int64())],
                                                 names=["conv", "turn", "role", "tie", "ids", "head", "long"])
        release()

    coded = rows.mapInArrow(run, f"conv {kind}, turn long, role string, tie string, ids array<int>, head long, long long")
    sort = ["conv", "turn", "role", "tie"]
    coded = scratch.put(scratch.put(coded, "coded").repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), "turns")
    parts = coded.groupBy(F.col("conv").alias("c"), F.col("part").alias("p")).agg(F.sum("long").alias("size"), F.count("*").alias("turns"))
    ahead = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("c", "p", *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"{x}_ahead") for x in ("size", "turns")])
    order = Window.partitionBy("conv", "part").orderBy("turn", "role", "tie")
    inside = F.coalesce(F.sum("long").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = coded.withColumn("nth", F.row_number().over(order) - 1).withColumn("inside", inside)
    out = out.join(parts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("start", F.col("inside") + F.col("size_ahead"))
    lossy = F.col("role") == LOSS_ROLE
    return out.select(
        "conv", "turn", (F.col("nth") + F.col("turns_ahead")).cast("long").alias("nth"), "ids", "start",
        F.when(lossy, F.col("start") + F.col("head")).otherwise(F.col("start")).alias("loss_from"),
        F.when(lossy, F.col("start") + F.col("long") - 1).otherwise(F.col("start")).alias("loss_to"),
    )


def _character_runs(b: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with about `limit` characters at most, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(False)
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > limit:
            yield b.slice(first, k - first)
            first, held = k, 0
        held += int(n) + 1
    if first < b.num_rows:
        yield b.slice(first)


def render(ids: list[int], tokens: str = TOKENIZER) -> str:
    """The text form of token ids, with the control strings of reserved ids."""
    out, run = [], []
    for i in [*ids, None]:
        if i is None or i in CONTROL:
            out.append(encoder(tokens).decode(run, skip_special_tokens=False) if run else "")
            run = []
            out.append(CONTROL[i] if i is not None else "")
        else:
            run.append(i)
    return "".join(out)


def read_turn(text: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    body = text[len(CONTROL[OPEN]) : -len(CONTROL[CLOSE])]
    at = re.match(r"(?:\\.|[^\\:])*", body, re.DOTALL).end()
    return unescape(body[:at]), unescape(body[at + len(CONTROL[MIDDLE]) :])


def read_turns(formatted: DataFrame, tokens: str = TOKENIZER) -> DataFrame:
    """(conv, nth, role, text, loss, form_chars): every turn, and what of it is under the loss mask, read from the token ids
    and loss spans alone, where they lie."""
    kind = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts, losses, chars = [], [], [], []
            for k, (start, a, z) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "loss_from", "loss_to")))):
                ids = b.column("ids")[k].as_py()
                form = render(ids, tokens)
                role, text = read_turn(form)
                roles.append(role)
                texts.append(text)
                losses.append(unescape(encoder(tokens).decode(ids[a - start : z - start], skip_special_tokens=False)) if z > a else "")
                chars.append(len(form))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("nth"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(losses, pa.string()), pa.array(chars, pa.int64())],
                                             names=["conv", "nth", "role", "text", "loss", "form_chars"])
        release()

    return formatted.mapInArrow(run, f"conv {kind}, nth long, role string, text string, loss string, form_chars long")


def read_back(formatted: DataFrame, tokens: str = TOKENIZER) -> DataFrame:
    """One row per conversation, from read_turns: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a conversation follows its turns one by one, so conversations are dealt out whole; only hashing is done
    there, as a stream, so one of any length needs no more memory than its longest turn.
    """
    kind = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, conv_type = None, None, None

        def done() -> pa.RecordBatch:
            values = [held[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            conv_type = b.schema.field("conv").type
            for conv, role, text, loss, chars in zip(*(b.column(c) for c in ("conv", "role", "text", "loss", "form_chars"))):
                conv, loss = conv.as_py(), loss.as_py()
                if held != (conv,):
                    if held:
                        yield done()
                    held, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role.as_py()}\n{text.as_py()}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars.as_py()
        if held:
            yield done()

    rows = read_turns(formatted, tokens).repartition("conv").sortWithinPartitions("conv", "nth")
    return rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(turns.unionByName(more))).withColumnRenamed("conv", "conv_id")


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + 4 + 2 + 8
    + length(regexp_replace(text, '(###|</turn>|\\)', '\\\1', 'g')) - length(text)
    + length(regexp_replace(role, '(###|</turn>|\\|:)', '\\\1', 'g')) - length(role) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
