r"""Chat formatting with loss masks that follow the tokenizer's offsets.

A conversation becomes one text: for each turn ``[INST]``, the role, ``[/INST]``,
the text, ``</s>``. Inside roles and texts a backslash is doubled and a control
string gets a backslash after its first character, so neither can be taken for
the template and both come back unchanged. The whole text is encoded once, with
offsets; the control strings are special tokens, so no other token crosses the
edge of a text. Turn spans and token spans are both sorted, so the tokens of
each turn are found by binary search; those of the assistant carry the loss.

Defined results: a null text or role is empty; rows of equal turn number stand in
order of role and text, rows without a number first; repeated rows are turns of
their own; rows with a null conv_id form one conversation; an empty table gives
an empty result; only conv_id, turn, role and text are read. A conversation is
the unit of the output, so its rows meet in one row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

OPEN, CLOSE, END = CONTROL = ("[INST]", "[/INST]", "</s>")
LOSS_ROLE = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + CLOSE, escape(text)
        parts += (head, body, END)
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn[len(OPEN) :].split(CLOSE, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def _tokenizer(path: str):
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens(list(CONTROL))
    return tokenizer


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked_spans(offsets: list[tuple[int, int]], turns: list[tuple[int, int]]) -> tuple[list[bool], list[tuple[int, int]]]:
    """Which tokens lie in a turn's span, and what they cover of it, turn by turn."""
    starts, ends = [s for s, _ in offsets], [e for _, e in offsets]
    mask, covered = [False] * len(offsets), []
    for start, end in turns:
        low, high = bisect_right(ends, start), bisect_left(starts, end)
        if low < high:
            mask[low:high] = [True] * (high - low)
            covered.append((max(start, starts[low]), min(end, max(ends[low:high]))))
    return mask, covered


FORMATTED = [
    StructField("n_turns", LongType()), StructField("formatted", StringType()),
    StructField("token_ids", ArrayType(IntegerType())), StructField("loss_mask", ArrayType(BooleanType())),
    StructField("loss_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
]


def format_chats(conversations: DataFrame, tokenizer: str | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, n_turns, formatted, token_ids, loss_mask (per token) and loss_spans (code points)."""
    path = tokenizer or default_tokenizer()
    none = F.lit("")
    turn = F.struct(
        "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = StructType([conversations.schema["conv_id"], *FORMATTED])
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                chats = [[(t["role"], t["text"]) for t in turns] for turns in part.column(1).to_pylist()]
                rendered = [render(c) for c in chats]
                rows = []
                encoded = encode.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                for chat, (text, spans), e in zip(chats, rendered, encoded):
                    own = [s for s, (role, _) in zip(spans, chat) if role == loss_role]
                    mask, covered = masked_spans(e.offsets, own)
                    rows.append((len(chat), text, e.ids, mask, [{"start": s, "end": t} for s, t in covered]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["conv_id", *[f.name for f in FORMATTED]])

    return whole.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss spans say, read back from them alone."""
    import hashlib

    schema = StructType([
        formatted.schema["conv_id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
        StructField("formatted_chars", LongType()),
    ])
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
