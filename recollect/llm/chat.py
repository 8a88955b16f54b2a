"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets. Turns' spans and tokens'
spans are both sorted, so a binary search finds the tokens of a turn; the loss mask is the
intersection of those tokens with the assistants' text spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import for_python, small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Control strings of the template. All begin with "<|", which a text never shows unescaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BODY = r"((?:[^<\\]++|\\.|<(?!\|))*+)"
MARKS = re.compile(rf"<\|turn\|>{BODY}<\|text\|>{BODY}<\|end\|>", re.S)


def escape(text: str) -> str:
    """Without "<|": a backslash goes before each backslash and between "<" and "|"."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted conversation, and each turn's text span (begin, end, role) in it, sorted."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation: undoes ``render``."""
    return [(unescape(m[1]), unescape(m[2])) for m in MARKS.finditer(formatted)]


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int, str]], role: str = "assistant") -> list[tuple[int, int, int]]:
    """(token, begin, end) of each token that meets a text span of ``role``, cut to the span.

    ``offsets`` are sorted. Empty spans and tokens meet nothing.
    """
    begins, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = []
    for begin, end, who in spans:
        if who != role:
            continue
        for k in range(bisect_right(ends, begin), bisect_left(begins, end)):
            a, b = max(begin, offsets[k][0]), min(end, offsets[k][1])
            if a < b:
                out.append((k, a, b))
    return out


def under(formatted: str, masked: list[tuple[int, int, int]]) -> str:
    """The text under the mask, read from the formatted conversation, unescaped.

    Tokens that hold bytes of one character share its offsets; each character counts once.
    """
    parts, last = [], 0
    for _, a, b in masked:
        if b > last:
            parts.append(formatted[max(a, last) : b])
            last = b
    return unescape("".join(parts))


def encoder(path: str = TOKENIZER):
    """The public tokenizer with the template's marks as tokens of their own, exact offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, TEXT, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def format_conversations(rows: DataFrame, path: str = TOKENIZER, role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_tokens, input_ids, and the loss mask of each conversation.

    The mask is three lists: loss_token, the masked tokens' numbers, and loss_begin and
    loss_end, the part of ``formatted`` that each covers.

    ``rows`` has conv_id, turn, role, text. Turns are ordered by turn, null first, equal turns
    by role and text; null role and text count as empty. Null conv_ids make one conversation.
    A conversation is one training example, rendered and encoded whole, so it is the unit of
    work. Repeated rows are repeated turns. An empty table gives an empty result; other
    columns are ignored.
    """
    for_python(rows.sparkSession)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_tokens", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("input_ids", "loss_token", "loss_begin", "loss_end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for b in small(batches):
            out: dict[str, list] = {k: [] for k in schema.names}
            for conv, roles, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                formatted, spans = render(list(zip(roles, texts, strict=True)))
                got = tokenizer.encode(formatted, add_special_tokens=False)
                loss = list(zip(*mask(got.offsets, spans, role), strict=True)) or [(), (), ()]
                for k, v in zip(schema.names, (conv, formatted, len(got.ids), got.ids, *loss), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    return whole.mapInArrow(run, "conv_id long, formatted string, n_tokens long, input_ids array<int>, loss_token array<int>, loss_begin array<int>, loss_end array<int>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says of each conversation: turns parsed from it, text under its mask."""
    for_python(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in small(batches):
            out = []
            for conv, text, *loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = parse(text)
                said = under(text, list(zip(*loss, strict=True)))
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(text)))
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))

    return formatted.select("conv_id", "formatted", "loss_token", "loss_begin", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
