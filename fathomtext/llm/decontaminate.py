"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds the normalised words of all items of a block. Training words are
streamed through it, its state gives the longest suffix that occurs in some item, and
where that reaches the window length (or a whole shorter item) the words are hit. Only
runs of words that the items know at all are streamed, found for whole batches at once.

Items come in blocks of bounded size, whose automata are built by the executors and written
to the shared folder. States are rows of flat arrays, with dictionaries only where a state
branches; names of items stand only at states of window depth. Automata of up to
``PASS_BYTES`` together are sent to the workers for one pass over the documents; a larger
benchmark makes more passes, never a larger broadcast, and no more than a pass's automata
are on the driver. Documents are judged where they are scanned: nothing is shuffled.

Defined cases: null or wordless texts and items have no words and match nothing; repeated
rows are judged each on its own; items that share an item_id are one item (null item_ids
are called "null"); an empty benchmark hits nothing; other columns, whatever their names,
are only carried.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomtext.llm._spark import drop, keep, lean
from fathomtext.llm._words import ALNUM, Words, utf8, word_slices, words

BLOCK_BYTES = 1 << 20  # of item texts in one automaton
PASS_BYTES = 48 << 20  # of automata that a worker holds at once


class Automaton:
    """Suffix automaton of several word sequences.

    ``word`` and ``to`` are a state's first transition, ``more`` has the others of states that branch."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        w = words(*utf8(pa.array([t for _, t in items], pa.string())), kind=ALNUM, lower=True)
        self.vocabulary, ids = np.unique(w.hashes, return_inverse=True)
        self.word, self.to, self.length, self.link = array("i"), array("i"), array("i"), array("i")
        self.more: dict[int, dict[int, int]] = {}
        self._add(0, -1)
        sequences = []
        for i, (name, _) in enumerate(items):
            seq = ids[w.at[i] : w.at[i + 1]].tolist()
            if seq:
                last = 0
                for x in seq:
                    last = self._extend(last, x)
                sequences.append((name, seq))
        self.shortest = min((min(len(s), window) for _, s in sequences), default=window)
        upward = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist()
        self.deep = array("i", range(len(self.length)))  # the state of the last `window` words
        for v in upward:
            if self.length[self.link[v]] >= window:
                self.deep[v] = self.deep[self.link[v]]
        self.names: dict[int, tuple[str, ...]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for name, seq in sequences:
            v = 0
            for i, x in enumerate(seq):
                v = self.step(v, x)
                if i + 1 >= window and name not in (known := self.names.get(self.deep[v], ())):
                    self.names[self.deep[v]] = (*known, name)
            if len(seq) < window:
                self.whole.setdefault(v, []).append((len(seq), name))
        self.short_above = bytearray(len(self.length))
        for v in upward if self.whole else ():
            self.short_above[v] = v in self.whole or self.short_above[self.link[v]]

    def step(self, v: int, x: int) -> int:
        """The state after word x, -1 if there is none."""
        if self.word[v] == x:
            return self.to[v]
        more = self.more.get(v)
        return more.get(x, -1) if more else -1

    def _set(self, v: int, x: int, to: int) -> None:
        if self.word[v] in (-1, x):
            self.word[v], self.to[v] = x, to
        else:
            self.more.setdefault(v, {})[x] = to

    def _add(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self.step(p, x) == q:
            self._set(p, x, clone)
            p = self.link[p]
        return clone

    def _extend(self, p: int, x: int) -> int:
        q = self.step(p, x)
        if q >= 0:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        cur = self._add(self.length[p] + 1, 0)
        while p >= 0 and self.step(p, x) < 0:
            self._set(p, x, cur)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, x)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return cur

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word in the vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stream(self, run: list[int]) -> Iterator[tuple[int, int, str]]:
        """(first word, last word, item) of each window and whole short item in the run."""
        v = length = 0
        for i, x in enumerate(run):
            to = self.step(v, x)
            while v and to < 0:
                v = self.link[v]
                length = self.length[v]
                to = self.step(v, x)
            if to >= 0:
                v = to
                length += 1
            if length >= self.window:
                for name in self.names[self.deep[v]]:
                    yield i - self.window + 1, i, name
            if length and self.short_above[v]:
                u = v
                while u > 0:
                    for n, name in self.whole.get(u, ()):
                        if n <= length:
                            yield i - n + 1, i, name
                    u = self.link[u]

    def hits(self, w: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items found in each row."""
        hit = np.zeros(len(w.hashes), bool)
        found: list[set[str]] = [set() for _ in w.counts]
        ids = self.known(w.hashes)
        inside = ids >= 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[w.at[:-1][w.counts > 0]] |= inside[w.at[:-1][w.counts > 0]]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[w.at[1:][w.counts > 0] - 1] |= inside[w.at[1:][w.counts > 0] - 1]
        a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        row = np.searchsorted(w.at, a, "right") - 1
        for x, y, r in zip(a.tolist(), b.tolist(), row.tolist(), strict=True):
            for first, last, name in self.stream(ids[x:y].tolist()):
                hit[x + first : x + last + 1] = True
                found[r].add(name)
        return hit, found


def _build(window: int):
    def build(table: pa.Table) -> pa.Table:
        items = list(zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True))
        return pa.table({"automaton": pa.array([pickle.dumps(Automaton(items, window))], pa.binary())})

    return build


def _passes(benchmark: DataFrame, window: int) -> Iterator[list[bytes]]:
    """Pickled automata of the benchmark's blocks, as many at a time as one pass may hold."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    n = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES) or 1
    blocks = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).groupBy("block").applyInArrow(_build(window), "automaton binary")
    blocks = keep(blocks, "automata")
    held: list[bytes] = []
    for row in blocks.toLocalIterator():
        own = bytes(row.automaton)
        if held and sum(map(len, held)) + len(own) > PASS_BYTES:
            yield held
            held = []
        held.append(own)
    yield held
    drop(blocks)


@lru_cache(maxsize=1)
def _loaded(pickled: tuple[bytes, ...]) -> list[Automaton]:
    """Of the pass that this worker is at: read once, whatever its number of tasks."""
    return [pickle.loads(x) for x in pickled]


def _found(batch: pa.RecordBatch, text: pa.Array, automata: list[Automaton]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Words, places of the hit words and items found, of each row, with those of earlier passes."""
    counts, spots, items = [], batch.column("spots").to_pylist(), batch.column("items").to_pylist()
    for a, b, w in word_slices(text, ALNUM, lower=True):
        counts += w.counts.tolist()
        for automaton in automata:
            hit, found = automaton.hits(w)
            for i in np.flatnonzero(w.per_row(hit)).tolist():
                spots[a + i] = sorted({*np.flatnonzero(hit[w.at[i] : w.at[i + 1]]).tolist(), *spots[a + i]})
                items[a + i] = sorted(found[i] | set(items[a + i]))
    return counts, spots, items


def _judge(pickled: tuple[bytes, ...], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _loaded(pickled)
        for batch in batches:
            n, spots, items = _found(batch, batch.column("text"), automata)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(n, pa.int64()), pa.array(spots, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[*carried, "n_words", "spots", "items"])

    return lean(run)


def _through(rows: DataFrame, benchmark: DataFrame, window: int, last=None) -> DataFrame:
    """rows (with text) through all passes: n_words, spots, items beside its columns; ``last``: makes another kernel of the last pass."""
    carried = rows.columns
    out = rows.select(*carried, F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("spots"), F.array().cast("array<string>").alias("items"))
    before = None
    for held in _passes(benchmark, window):
        if before is not None:
            out = keep(out.mapInArrow(_judge(before, carried), out.schema), "hits")
        before = tuple(held)
    return last(out, before) if last else out.mapInArrow(_judge(before, carried), out.schema)


def _contaminated(spots: int, n: int) -> bool:
    return spots > 0 and 20 * spots >= n


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text, n_words, spots (numbers of the hit words), items (found), contaminated of each row."""
    out = _through(docs.select("doc_id", "text"), benchmark, window)
    return out.withColumn("contaminated", (F.size("spots") > 0) & (20 * F.size("spots") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    h = hits(docs, benchmark, window)
    return h.select("doc_id", "n_words", F.size("spots").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def _cut(text: str, spots: list[int]) -> str:
    """The text without the spans of its hit words (from a span's first word to its last)."""
    raw = text.encode()
    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), kind=ALNUM, lower=True, hashed=False)
    out, upto = [], 0
    for run in np.split(np.array(spots), np.flatnonzero(np.diff(spots) > 1) + 1):
        out.append(raw[upto : w.starts[run[0]]])
        upto = w.ends[run[-1]]
    return (b"".join(out) + raw[upto:]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs without contaminated rows; from rows under the coverage limit the hit spans are cut out.

    An integer column n_chars follows the text where it was the text's length before."""
    names, schema = docs.columns, docs.schema

    def kernel(pickled: tuple[bytes, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = _loaded(pickled)
            for batch in batches:
                rows = batch.column("row")
                cols = {n: rows.field(n) for n in names}
                n, spots, _ = _found(batch, cols["text"], automata)
                good = np.array([not _contaminated(len(s), m) for s, m in zip(spots, n, strict=True)], bool)
                changed = [i for i, s in enumerate(spots) if s and good[i]]
                if changed:
                    texts, lengths = cols["text"].to_pylist(), cols["n_chars"].to_pylist() if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type) else None
                    for i in changed:
                        was, texts[i] = len(texts[i]), _cut(texts[i], spots[i])
                        if lengths and lengths[i] == was:
                            lengths[i] = len(texts[i])
                    cols["text"] = pa.array(texts, cols["text"].type)
                    if lengths:
                        cols["n_chars"] = pa.array(lengths, cols["n_chars"].type)
                keep_ = pa.array(good)
                yield pa.RecordBatch.from_arrays([pc.filter(c, keep_) for c in cols.values()], names=names)

        return lean(run)

    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return _through(whole, benchmark, window, lambda df, held: df.select("row", "spots", "items").mapInArrow(kernel(held), schema))
