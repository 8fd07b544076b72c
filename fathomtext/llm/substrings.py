"""Repeated word windows across documents by prefix-partitioned suffix trees.

Every suffix is cut to one window of words, the depth that matters. Its group is given by
a variable-length prefix: the words up to and including the window's least word k-gram.
Equal windows have equal prefixes, so all copies of a window meet in one group, and the
neighbouring suffixes of a text that share the k-gram travel as one segment. A k-gram
that occurs once proves its suffixes unique: only counts of k-grams cross the network
for them. The other segments are sorted into groups small enough for memory, where the
truncated subtrees are built level by level (names of 1, 2, 4, 8, ... words, pairs of
names naming the next level); a node at full depth with several leaves is a repeat.
Groups larger than ``GROUP`` segments take the longest prefix instead, the whole window:
such a group is one node, reduced by partial aggregations (of equal segments first, then
of the windows of distinct segments) and joined back, never gathered.

Words are compared by 64-bit hashes in subtrees, windows of large groups by 128 bits.

Defined cases: null text has no words; a window starts earlier in a smaller doc_id or at a
smaller place of the same doc_id (null last); rows under one doc_id are versions of one
document, so windows at the same place of two versions don't remove each other, and
repeated rows all get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomtext.llm._spark import drop, keep, lean
from fathomtext.llm._words import Words, mix, utf8, word_slices, words

GRAM = 6
GROUP = 1000
CHUNK_WORDS = 400_000


def _slide(x: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of each ``size`` neighbours, the first of equal ones."""
    out, have = np.arange(len(x)), 1
    while have < size:
        step = min(have, size - have)
        if len(out) <= step:
            return out[:0]
        left, right = out[:-step], out[step:]
        out = np.where(x[left] <= x[right], left, right)
        have += step
    return out


def segments(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor): the windows of a row whose least k-gram is at one place."""
    grams, _ = w.windows(min(GRAM, window))
    least = _slide(grams, window - min(GRAM, window) + 1)
    n = len(w.hashes)
    row = w.row_of()
    whole = np.arange(n) + window <= w.at[1:][row] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    place, r = least[at], row[at]
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]  # a place lies in one row, and equal windows of one text have different places
    first = np.flatnonzero(new)
    return r[first], at[first], np.diff(np.append(first, len(at))), grams[place[first]].astype(np.int64)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid")
            for a, b, w in word_slices(batch.column("text")):
                row, _, _, anchor = segments(w, window)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), rid.slice(a, b - a).take(pa.array(row))], names=["anchor", "rid"])

    return lean(run)


def _result(w: Words, i: int, removed: np.ndarray | None) -> tuple[int, int, str]:
    """n_words, n_removed, kept_sha256 of row i."""
    a, b = w.at[i], w.at[i + 1]
    raw = w.data[w.rows[i] : w.rows[i + 1]].tobytes()
    found = raw.split()  # bytes split at ASCII white space only
    if removed is not None:
        found = [x for x, r in zip(found, removed, strict=True) if not r]
    return int(b - a), int(b - a) - len(found), hashlib.sha256(b" ".join(found)).hexdigest()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a repeated k-gram are done; the others keep their text."""
    for batch in batches:
        touched = np.asarray(batch.column("anchors").is_valid())
        text = batch.column("text")
        for a, b, w in word_slices(text):
            done = [None if touched[a + i] else _result(w, i, None) for i in range(b - a)]
            part = text.take(pa.array(np.arange(a, b), mask=~touched[a:b]))
            others = [batch.column(c).slice(a, b - a) for c in ("doc_id", "rid", "anchors", "hot")]
            yield pa.RecordBatch.from_arrays([*others, part, pa.array([d and d[0] for d in done], pa.int64()), pa.array([d and d[2] for d in done], pa.string())], names=["doc_id", "rid", "anchors", "hot", "text", "n_words", "sha"])


def _chosen(batch: pa.RecordBatch, window: int, column: str) -> Iterator[tuple[int, Words, np.ndarray, ...]]:
    wanted = batch.column(column)
    for a, b, w in word_slices(batch.column("text")):
        row, first, n, anchor = segments(w, window)
        edge = np.searchsorted(row, np.arange(b - a + 1))
        take = np.zeros(len(row), bool)
        for i in range(b - a):
            own = wanted[a + i].values if wanted[a + i].is_valid else None
            if own is not None and len(own):
                take[edge[i] : edge[i + 1]] = np.isin(anchor[edge[i] : edge[i + 1]], np.asarray(own))
        yield a, w, row[take], first[take], n[take], anchor[take]


def _ship(window: int):
    """Segments of groups that fit memory, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, w, row, first, n, anchor in _chosen(batch, window, "anchors"):
                data = w.data.tobytes()
                bodies = [data[x:y] for x, y in zip(w.starts[first].tolist(), w.ends[first + n + window - 2].tolist(), strict=True)]
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column("doc_id").take(at), batch.column("rid").take(at), pa.array((first - w.at[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(bodies, pa.binary()).cast(pa.string())], names=["anchor", "doc_id", "rid", "first", "n", "body"])

    return lean(run)


def _spell(window: int):
    """Segments of large groups: a 128-bit name of the whole segment and of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, w, row, first, n, _ in _chosen(batch, window, "hot"):
                edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                j = np.arange(edge[-1]) - np.repeat(edge[:-1], n)
                at = np.repeat(first, n) + j
                cols = []
                for hashes in (w.hashes, mix(w.hashes ^ np.uint64(0x5555AAAA5555AAAA))):
                    f = Words(w.data, w.rows, w.starts, w.ends, w.at, hashes).windows(window)[0][at]
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(f + j.astype(np.uint64)), dtype=np.uint64)])
                    name = mix((total[edge[1:]] - total[edge[:-1]]) ^ n.astype(np.uint64))
                    cols += [pa.array(name.astype(np.int64)), pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(f.astype(np.int64)))]
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*cols, batch.column("doc_id").take(rows), batch.column("rid").take(rows), pa.array((first - w.at[row]).astype(np.int32))], names=["s1", "f", "s2", "g", "doc_id", "rid", "first"])

    return lean(run)


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def deep_nodes(w: Words, window: int) -> np.ndarray:
    """The node at full depth below each word (meaningless where a row ends before)."""
    levels = {1: np.unique(w.hashes, return_inverse=True)[1]}

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])

    depth, bits = 1, window
    while depth * 2 <= window:
        levels[depth * 2] = _named(levels[depth], shifted(levels[depth], depth))
        depth *= 2
    name, have = levels[depth], depth
    bits -= depth
    while bits:
        depth = 1 << (bits.bit_length() - 1)
        name = _named(name, shifted(levels[depth], have))
        have, bits = have + depth, bits - depth
    return name


def repeats(rows: dict[str, np.ndarray], bodies: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, n): runs of windows that start earlier elsewhere, for segments of whole groups."""
    w = words(*utf8(bodies))
    name = deep_nodes(w, window)
    n = rows["n"].astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    node = name[w.at[row] + j]
    doc, start = rows["doc"][row], rows["first"][row] + j
    order = np.lexsort((start, doc, node))
    lead = np.concatenate([[True], node[order][1:] != node[order][:-1]])
    earliest = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    gone = np.zeros(len(node), bool)
    gone[order] = (doc[order] != doc[earliest]) | (start[order] != start[earliest])
    at = np.flatnonzero(gone)
    new = np.ones(len(at), bool)
    new[1:] = (row[at][1:] != row[at][:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return row[at[first]], start[at[first]], np.diff(np.append(first, len(at)))


def _subtrees(window: int):
    """Groups come sorted by anchor; they are taken together up to CHUNK_WORDS, never cut apart."""

    def solve(table: pa.RecordBatch) -> pa.RecordBatch:
        ids = table.column("doc_id")
        doc = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        row, first, n = repeats({"n": table.column("n").to_numpy(), "doc": doc, "first": table.column("first").to_numpy().astype(np.int64)}, table.column("body"), window)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([ids.take(at), table.column("rid").take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "rid", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, 4096))
                batch = batch.slice(4096)
                if sum(pc.sum(b.column("n")).as_py() + b.num_rows * window for b in held) > CHUNK_WORDS:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    anchor = whole.column("anchor").to_numpy()
                    cut = int(np.searchsorted(anchor, anchor[-1]))
                    if cut:
                        yield solve(whole.slice(0, cut))
                    held = [whole.slice(cut)]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            if whole:
                yield solve(whole[0])

    return lean(run)


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for a, b, w in word_slices(batch.column("text")):
                out = []
                for i in range(b - a):
                    gone = np.zeros(int(w.counts[i]), bool)
                    for s in chain.from_iterable(spans[a + i] or []):
                        gone[s["first"] : s["first"] + s["n"] + window - 1] = True
                    out.append(_result(w, i, gone))
                n, r, h = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return lean(run)


def remove_repeats(docs: DataFrame, window: int = 20, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    anchors = keep(own.select("rid", "text").mapInArrow(_anchors(window), "anchor bigint, rid bigint"), "anchors")
    # written, so that the join is one of plain shuffles and Spark can split a frequent anchor
    counted = keep(anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "counted")
    shared = anchors.join(counted, "anchor").groupBy("rid").agg(F.collect_set(F.when(F.col("c") <= group, F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("c") > group, F.col("anchor"))).alias("hot"))
    state = own.join(shared, "rid", "left").select("doc_id", "rid", "text", "anchors", "hot")
    state = keep(state.mapInArrow(lean(_settle), f"doc_id {kind}, rid bigint, anchors array<bigint>, hot array<bigint>, text string, n_words bigint, sha string"), "state")
    drop(anchors, counted)
    open_ = state.where("anchors IS NOT NULL")

    shipped = open_.where("size(anchors) > 0").select("doc_id", "rid", "anchors", "text").mapInArrow(_ship(window), f"anchor bigint, doc_id {kind}, rid bigint, first int, n int, body string")
    small = shipped.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_subtrees(window), f"doc_id {kind}, rid bigint, first int, n int")

    # large groups: equal segments fold to their earliest one, only distinct segments are opened into windows
    spelt = keep(open_.where("size(hot) > 0").select("doc_id", "rid", "hot", "text").mapInArrow(_spell(window), f"s1 bigint, f array<bigint>, s2 bigint, g array<bigint>, doc_id {kind}, rid bigint, first int"), "spelt")
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("first").alias("f"))
    distinct = spelt.groupBy("s1", "s2").agg(F.min(place).alias("m"), F.first("f").alias("f"), F.first("g").alias("g"))
    windows = distinct.select("s1", "s2", "m", F.posexplode(F.arrays_zip("f", "g")).alias("o", "w"))
    windows = windows.select("s1", "s2", "o", "w.f", "w.g", F.struct(F.col("m.x").alias("x"), F.col("m.d").alias("d"), (F.col("m.f") + F.col("o")).alias("f")).alias("at"))
    earliest = keep(windows.groupBy("f", "g").agg(F.min("at").alias("b")), "earliest")
    named = keep(windows.join(earliest, ["f", "g"]).groupBy("s1", "s2").agg(F.collect_list(F.struct("o", "b")).alias("bs")), "named")  # at most window - GRAM + 1 each
    drop(earliest)

    def later(x):
        return F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), (F.col("first") + x["o"]).alias("f")) > x["b"]

    large = spelt.select("s1", "s2", "doc_id", "rid", "first").join(named, ["s1", "s2"]).select("doc_id", "rid", F.transform(F.filter("bs", later), lambda x: F.struct((F.col("first") + x["o"]).alias("first"), F.lit(1).alias("n"))).alias("s")).where("size(s) > 0")

    # rows of different documents may share a rid (at 10^10 rows some do): each takes the spans of its own doc_id
    spans = small.select("rid", "doc_id", F.array(F.struct("first", "n")).alias("s")).unionByName(large).groupBy("rid").agg(F.collect_set(F.struct("doc_id", "s")).alias("spans"))
    done = state.where("anchors IS NULL").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    own_spans = F.transform(F.filter("spans", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id"))), lambda x: x["s"])
    rest = open_.select("doc_id", "rid", "text").join(spans, "rid", "left").select("doc_id", "text", own_spans.alias("spans"))
    return done.unionByName(rest.mapInArrow(_finish(window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"))
