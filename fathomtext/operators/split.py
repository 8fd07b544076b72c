"""Splitting a text into chunks within a byte or token budget, each with its source span.

The kernel is pure Python over UTF-8 bytes; beside it stand an Arrow UDF that returns
an array of chunks, a DataFrame transform and a SQL table function. One shuffle-free stage.
Python holds the chunks of about AT_ONCE bytes of text at a time; a batch's others are in Arrow.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from fathomtext.functions.models import BYTES_PER_TOKEN, DEFAULT, Limits, Registry
from fathomtext.operators import markdown
from fathomtext.operators.tokens import _WORD, Counter, back_up, extent

FILL = 50  # a boundary below this percentage of the window isn't taken
CHUNK = "text:string,start:int,end:int,ordinal:int,headings:array<string>"
_ARROW = {"text": pa.string(), "start": pa.int32(), "end": pa.int32(), "ordinal": pa.int32(), "headings": pa.list_(pa.string())}
AT_ONCE = 1 << 20
BLANK = b" \t\n\r"
_SENTENCE = re.compile(rb"(?s).*[.!?](?=[ \t\n\r])")
_LAST_BLANK = re.compile(rb"(?s).+(?=[ \t\n\r])")


class Chunk(NamedTuple):
    text: str
    start: int
    end: int
    ordinal: int
    headings: list[str] | None = None


@dataclass(frozen=True)
class SplitOptions:
    max_bytes: int = 0
    overlap: int = 0
    min_bytes: int = 0
    markdown: bool = False
    max_tokens: int = 0
    tokenizer: Counter | None = None
    bytes_per_token: float = 0.0
    dedupe_overlap: bool = False  # leaves out chunks inside their predecessor
    limits: dict[str, Limits] = field(default_factory=lambda: dict(DEFAULT.limits), compare=False)
    aliases: dict[str, str] = field(default_factory=lambda: dict(DEFAULT.aliases), compare=False)


def _budget(model: str, size: int, o: SplitOptions) -> tuple[int, bool]:
    """Bytes a chunk may have (0: no bound), and whether tokens govern."""
    if o.max_tokens > 0 and o.tokenizer is not None:
        return (o.max_bytes if o.max_bytes > 0 else size), True
    if o.max_tokens > 0:
        derived = int(o.max_tokens * (o.bytes_per_token if o.bytes_per_token > 0 else BYTES_PER_TOKEN))
        return (min(derived, o.max_bytes) if o.max_bytes > 0 else derived), False
    if o.max_bytes > 0:
        return o.max_bytes, False
    return Registry(o.limits, o.aliases).lookup_limits(model).max_bytes, False  # as they were when the options were made


def _boundary(text: bytes, start: int, limit: int, floor: int, sections: list[int]) -> int:
    """Where to cut: the last section, paragraph, line, sentence or word end of the window, else at the limit."""
    i = bisect.bisect_right(sections, limit)
    if i and sections[i - 1] > start:
        return sections[i - 1]
    for mark in (b"\n\n", b"\n"):
        at = text.rfind(mark, start, limit)
        if at >= 0 and at + len(mark) > floor:
            return at + len(mark)
    window = text[start:limit]
    for pattern in (_SENTENCE, _LAST_BLANK):
        found = pattern.match(window)
        if found and start + found.end() > floor:
            return start + found.end()
    return back_up(text, limit)


def _cut(text: bytes, a: int, b: int, ordinal: int) -> tuple[int, int, int] | None:
    piece = text[a:b]
    a += len(piece) - len(piece.lstrip(BLANK))
    body = piece.strip(BLANK)
    return (a, a + len(body), ordinal) if body else None


def split(text: str, model: str = "", o: SplitOptions = SplitOptions()) -> list[Chunk]:
    return list(chunks(text, model, o))


def chunks(text: str, model: str = "", o: SplitOptions = SplitOptions()) -> Iterator[Chunk]:
    """As split, one chunk at a time; only the spans of the whole text are held."""
    if not _WORD.search(text):
        return
    raw = text.encode()
    n = len(raw)
    most, by_tokens = _budget(model, n, o)

    def chunk(span: tuple[int, int, int], path: list[str] | None = None) -> Chunk:
        return Chunk(raw[span[0] : span[1]].decode("utf-8", "replace"), *span, path)

    if most <= 0 or (n <= most and not by_tokens):
        if only := _cut(raw, 0, n, 0):
            yield chunk(only)
        return
    most = max(most, 4)
    found = markdown.scan(raw) if o.markdown else []
    sections = [h.start for h in found]
    overlap = min(max(o.overlap, 0), most // 2)
    spans: list[tuple[int, int, int]] = []
    start, last = 0, -1
    while start < n:
        limit = min(start + most, n)
        if by_tokens:
            limit = min(limit, extent(o.tokenizer, raw, start, limit, o.max_tokens))
        if limit >= n:
            if span := _cut(raw, start, n, len(spans)):
                spans.append(span)
            break
        end = _boundary(raw, start, limit, start + (limit - start) * FILL // 100, sections)
        if end <= start:
            end = start + 1
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
        if span := _cut(raw, start, end, len(spans)):
            spans.append(span)
            last = span[0]
        following = back_up(raw, end - overlap)
        start = end if following <= start or following <= last else following
    spans = _absorb(raw, spans, most, o, by_tokens)
    if o.dedupe_overlap:
        held: list[tuple[int, int, int]] = []
        for a, b, _ in spans:
            if not held or b > held[-1][1]:
                held.append((a, b, len(held)))
        spans = held
    for s in spans:
        yield chunk(s, markdown.path_at(found, s[0], sections) if found else None)


def _absorb(raw: bytes, spans: list, most: int, o: SplitOptions, by_tokens: bool) -> list:
    """A short last chunk is merged with its neighbour, or the two are cut anew near their middle."""
    if o.min_bytes <= 0 or len(spans) < 2 or spans[-1][1] - spans[-1][0] >= o.min_bytes:
        return spans

    def fits(a: int, b: int) -> bool:
        return b - a <= most and (not by_tokens or o.tokenizer(raw[a:b].decode("utf-8", "replace")) <= o.max_tokens)

    *head, (a, _, k), (_, b, k2) = spans
    if fits(a, b):
        return [*head, (a, b, k)]
    low, high = max(a, b - most), min(b, a + most)
    at = _boundary(raw, a, min((a + b) // 2, high), low, [])
    if not a < at < b:
        return spans
    left, right = _cut(raw, a, at, k), _cut(raw, at, b, k2)
    if not left or not right or not fits(*left[:2]) or not fits(*right[:2]):
        return spans
    return [*head, left, right]


def _pieces(texts: pa.Array, model: str, options: SplitOptions) -> Iterator[tuple[list[int], list[pa.Array]]]:
    """The chunks of a column of texts by and by: each one's row, and a column for each field."""
    rows: list[int] = []
    held: list[Chunk] = []
    size = 0

    def taken() -> tuple[list[int], list[pa.Array]]:
        return rows, [pa.array([c[k] for c in held], kind) for k, kind in enumerate(_ARROW.values())]

    for i in range(len(texts)):
        text = texts[i].as_py()
        for c in chunks(text, model, options) if text is not None else ():
            rows.append(i)
            held.append(c)
            size += 256 + c.end - c.start  # a chunk has objects beside its text
            if size >= AT_ONCE:
                yield taken()
                rows, held, size = [], [], 0
    if held:
        yield taken()


def split_chunks(text: Column, model: str = "", options: SplitOptions = SplitOptions()) -> Column:
    """array<chunk> of a text Column; null stays null."""

    @arrow_udf(f"array<struct<{CHUNK}>>")
    def run(texts: pa.Array) -> pa.Array:
        counts = [0] * len(texts)
        parts = []
        for rows, columns in _pieces(texts, model, options):
            parts.append(pa.StructArray.from_arrays(columns, list(_ARROW)))
            for i in rows:
                counts[i] += 1
        offsets, at = [], 0
        for n, known in zip(counts, texts.is_valid().to_pylist(), strict=True):
            offsets.append(at if known else None)
            at += n
        found = pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_ARROW.items()))
        return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), found)

    return run(text)


def split_df(df: DataFrame, text: str = "text", model: str = "", options: SplitOptions = SplitOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a chunk: the kept columns, then text, start, end, ordinal, headings.

    Chunks leave Python by and by, so its memory goes with the batches it is sent (Spark bounds
    their rows and bytes), not with the chunks that they give."""
    kept = df.select(*keep)
    names = [*(f"kept{k}" for k in range(len(kept.columns))), *_ARROW]
    own = df.select(*keep, F.col(text)).toDF(*names[: len(kept.columns)], "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            for rows, columns in _pieces(texts, model, options):
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in others), *columns], names)

    schema = StructType([*own.schema.fields[:-1], *StructType.fromDDL(CHUNK).fields])
    return own.mapInArrow(run, schema).toDF(*kept.columns, *_ARROW)


def register_sql(spark: SparkSession, name: str = "split_text") -> None:
    """``LATERAL split_text(text, max_bytes, overlap)`` for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="text string, start int, end int, ordinal int, headings array<string>")
    class SplitText:
        def eval(self, text: str, max_bytes: int, overlap: int):
            for c in split(text, "", SplitOptions(max_bytes=max_bytes, overlap=overlap)) if text is not None else ():
                yield tuple(c)

    spark.udtf.register(name, SplitText)
