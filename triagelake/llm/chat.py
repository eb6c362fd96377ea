"""Chat formatting with offset-aligned masks.

A conversation is rendered whole by a template, tokenized once with offsets, and the sorted spans of its assistant turns
are intersected with the tokens' spans by binary search. The mask names the tokens, and for each the characters of it
that lie in an assistant's text, so that a token across a turn's edge teaches nothing outside the turn.

The template: ``<turn ROLE>\\n`` TEXT ``\\n</turn>\\n``. Within roles and texts a backslash stands before each backslash, ``<``
and ``>``, so no control string can occur in them and reading back is exact.

A conversation is one string and one encoding by its nature, so its turns meet in one task; tasks stream conversations
and hold one at a time.

Defined results: null texts and roles are empty; turns go by turn, then role and text, nulls first; repeated rows are turns of
their own; rows without a conv_id can't be told to belong together, so each is a conversation of its own; ids of any type
will do; an empty table gives an empty result. Only the four named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn {}>\n", "\n</turn>\n"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)\n</turn>\n", re.S)
TAUGHT = "assistant"
#: Conversations that are handed on together.
BATCH = 256
_TOKENIZERS: dict[str, object] = {}


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN.format(escape(role)), escape(text)
        at += len(head)
        if role == TAUGHT and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, start, end) of all that tokens have in common with spans; both are sorted."""
    starts, ends, out = offsets[:, 0], offsets[:, 1], []
    for a, b in spans:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        for k in range(lo, hi):
            s, e = max(a, int(starts[k])), min(b, int(ends[k]))
            if s < e:
                out.append((k, s, e))
    return out


def tokenizer(name: str):
    if name not in _TOKENIZERS:
        import public_tokenizers
        from tokenizers import Tokenizer, processors

        found = Tokenizer.from_file(public_tokenizers.path(name))
        found.encode_special_tokens = True
        found.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets then cover blanks too
        _TOKENIZERS[name] = found
    return _TOKENIZERS[name]


def format_chats(conversations: DataFrame, name: str = "byte_bpe_50k.json", apart: Column | None = None) -> DataFrame:
    """conv_id, formatted, ids, mask_tokens, mask_starts, mask_ends (the mask as parallel arrays).

    ``apart`` (whole numbers) tells conversations of one id apart.
    """
    apart = F.lit(0).cast("long") if apart is None else apart
    kind = conversations.schema["conv_id"].dataType.simpleString()
    types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["formatted", "ids", "mask_tokens", "mask_starts", "mask_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key, key_type, turns, rows = tokenizer(name).encode, None, None, [], []

        def finish() -> None:
            text, spans = render(turns)
            found = encode(text, add_special_tokens=False)
            hits = mask(np.array(found.offsets, np.int64).reshape(-1, 2), spans)
            rows.append((key[0], text, found.ids, [k for k, *_ in hits], [s for _, s, _ in hits], [e for *_, e in hits]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["conv_id", *names])

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "own", "role", "text"))
            for *conv, role, text in zip(*columns):
                if turns and conv != key:
                    finish()
                    turns = []
                    if len(rows) >= BATCH:
                        yield out()
                key = conv
                turns.append((role or "", text or ""))
        if turns:
            finish()
        if rows:
            yield out()

    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(apart).alias("own")
    rows_ = conversations.select("conv_id", own, "turn", "role", "text").repartition("conv_id", "own")
    ordered = rows_.sortWithinPartitions("conv_id", "own", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, mask_tokens array<int>, mask_starts array<int>, mask_ends array<int>")


def masked_text(formatted: str, starts: list[int], ends: list[int]) -> str:
    """All text under the mask, unescaped. Tokens that share a character overlap; each character counts once."""
    pieces, done = [], 0
    for s, e in zip(starts, ends):
        s = max(s, done)
        if s < e:
            pieces.append(formatted[s:e])
            done = e
    return unescape("".join(pieces))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens, from the output alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "mask_starts", "mask_ends"))):
                turns, loss = parse(text), masked_text(text, starts, ends)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["conv_id", *names])

    return formatted.select("conv_id", "formatted", "mask_starts", "mask_ends").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: The conversation that the query adds: its texts look like control strings.
PROBE = r"\### Assistant: </turn> ok"


def chat_query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-7).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TAUGHT).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    both = conversations.select("conv_id", "turn", "role", "text", F.lit(0).cast("long").alias("added"))
    both = both.union(added.withColumn("added", F.lit(1).cast("long")))
    return read_back(format_chats(both, apart=F.col("added")))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS own FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', -1
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', -1)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(17 + length(regexp_replace(role, '[\\<>]', '..', 'g')) + length(regexp_replace(text, '[\\<>]', '..', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, own
"""
