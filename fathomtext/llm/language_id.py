"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent character n-grams (lengths 1 to 3, lower case,
runs of non-letters as one space) in rank order, over all labelled texts. A text's own
most frequent n-grams are ranked the same way, and each is out of place by the difference
of its ranks, or by the profile's length if the profile lacks it; the profile with the
smallest sum is the language. Counting is done on whole-batch arrays; profiles are counted
with map-side sums per (language, n-gram).

Defined cases: a null text or one without letters is "und" with score 0; ties go to the
language first in code point order; rows without a label teach nothing; repeated rows
count as often as they occur; with no labelled text at all every text is "und".
A combining mark counts in n-grams, but a text of marks without a letter is "und".
Other columns aren't looked at; an empty table gives an empty result.
The profiles go to the workers whole: languages x PROFILE numbers of 8 bytes, whatever
the corpus size (3 MB for a thousand languages).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.llm._spark import lean
from fathomtext.llm._words import slices, utf8

PROFILE = 400
UND = "und"
_SPACE = 32

_fold = np.full(0x110000, _SPACE, np.uint32)
_letter = np.zeros(0x110000, bool)
_ready = False


def _table() -> np.ndarray:
    """Lower-cased letter of each code point, a space for all that are no letters."""
    global _ready
    if not _ready:
        import sys
        import unicodedata

        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if unicodedata.category(x)[0] in "LM" and not 0xD800 <= c <= 0xDFFF:
                low = x.lower()
                _fold[c] = ord(low) if len(low) == 1 else c
                _letter[_fold[c]] |= unicodedata.category(x)[0] == "L"
        _ready = True
    return _fold


def ngrams(codes: np.ndarray) -> np.ndarray:
    """All 1-, 2- and 3-grams of folded code points, packed into 64 bits; spaces alone are no n-gram."""
    c = codes.astype(np.uint64) + np.uint64(1)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([c[codes != _SPACE], two, three])


def folded(text: str, table: np.ndarray) -> np.ndarray:
    """Code points after folding, runs of non-letters as one space, one space at either end."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint32)
    gap = codes == _SPACE
    return codes[~(gap & np.concatenate([[False], gap[:-1]]))]


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    g = np.sort(ngrams(codes))
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    counts = np.diff(np.append(first, len(g)))
    values = g[first]
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        near = counts >= least
        values, counts = values[near], counts[near]
    return values[np.argsort(-counts, kind="stable")[:most]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n) of a batch's labelled texts."""
    table = _table()
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text")
        for lang in sorted(set(langs)):
            part = texts.filter(pa.array(langs == lang))
            _, offsets = utf8(part)
            for a, b in slices(offsets):
                own = [ngrams(folded(x, table)) for x in part.slice(a, b - a).to_pylist()]
                if own:
                    values, counts = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from (text, lang): all rows are counted; at most size n-grams a language are collected."""
    grams = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(lean(_counted), "lang string, gram bigint, n bigint")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.toLocalIterator():
        profiles.setdefault(row.lang, []).append((row.r, row.gram))
    return {k: np.array([g for _, g in sorted(profiles[k])], np.uint64) for k in sorted(profiles)}


class Ranker:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names = list(profiles)
        self.size = size
        self.grams = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None, table: np.ndarray) -> tuple[str, float]:
        codes = folded(text or "", table)
        if not self.names or not _letter[codes].any():
            return UND, 0.0
        own = ranked(codes, self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.rank[:, np.where(self.grams[at] == own, at, len(self.grams))]
        off = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(off.argmin())
        return self.names[best], float(1 - off[best] / (self.size * len(own)))


def _predicted(profiles: dict[str, np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        ranker = Ranker(profiles, size)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = [ranker.predict(t.as_py(), table) for t in part.column("text")]
                others = [part.column(n) for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*others, pa.array([x for x, _ in got], pa.string()), pa.array([min(max(s, 0.0), 1.0) for _, s in got], pa.float64())], names=[*(n for n in part.schema.names if n != "text"), "lang_pred", "score"])

    return lean(run)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None, size: int = PROFILE) -> DataFrame:
    """doc_id, the extra columns, lang_pred and score (1: every n-gram in its place) of each row; no shuffle."""
    own = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in (extra or {}).items()), F.col(text_col).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text")
    return own.mapInArrow(_predicted(profiles, size), f"{fields}, lang_pred string, score double")
