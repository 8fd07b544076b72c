"""Near-duplicate groups by circulant MinHash.

Two permutations make all coordinates of a signature: an initial one scatters a
document's shingles over a circle of ``CIRCLE`` places, and a second one, circularly
shifted by 1, 2, 3, ... places, is minimised over them (C-MinHash). A shingle's values
under all shifts are neighbours in one table, so a signature is the element-wise
minimum of table slices. Signatures are banded; documents that share a band are
candidates, and every link is confirmed by the exact Jaccard index of the full sets.

Copies are folded first: documents with equal shingle sets (equal 128-bit digests of the
whole set) form a class, and only classes are banded and compared. In a bucket of any size
each class is paired with the bucket's pivot (one row each, by a partial aggregation and a
join). The pivot is the member whose bands are most shared, so copies meet the text they
were made from. Buckets whose members are still in different components after that are
dealt in blocks, and a kernel compares the blocks' members of different components: in the
first band that two share, by signature, and those that agree to within four standard
deviations of the limit by their full sets. It answers with the links that join components
(a forest of them), never with pairs, so rows stay in proportion to the members of a bucket
while no candidate is left out.

With 42 bands of 6 rows a pair at Jaccard 0.8 is missed with probability 2.8e-6 by the
bands and 3e-5 by the agreement.

Defined cases: null or wordless text has an empty set, is linked with nothing and is its
own component; a repeated row joins its copies' component; component_id is the smallest
non-null doc_id reachable (null if there is none), and kept is doc_id <=> component_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomtext.llm._spark import drop, keep, lean
from fathomtext.llm._words import Words, mix, shingles, utf8, word_slices

CIRCLE = 1 << 20
GATHER = 512  # shingles whose table slices are held at once
AT_ONCE = 2 << 20  # bytes of text whose sets are held at once
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20  # of one side of a comparison


def _second_permutation(width: int) -> np.ndarray:
    """All circular windows of a fixed random permutation of the circle, as a view of one item each."""
    table = np.random.Generator(np.random.PCG64(7)).permutation(CIRCLE).astype(np.uint32)
    return np.ndarray((CIRCLE,), f"V{4 * width}", np.concatenate([table, table[:width]]), strides=(4,))


def signatures(values: np.ndarray, at: np.ndarray, width: int, view: np.ndarray | None = None) -> np.ndarray:
    """Circulant MinHash of each row's shingles; rows without any get the largest value."""
    view = _second_permutation(width) if view is None else view
    # the first permutation: a mixed 64-bit hash folded onto the circle
    place = (mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    out = np.full((len(at) - 1, width), np.iinfo(np.uint32).max, np.uint32)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for x in range(a, b, GATHER):
            least = view[place[x : min(x + GATHER, b)]].view(np.uint32).reshape(-1, width).min(axis=0)
            out[i] = least if x == a else np.minimum(out[i], least)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        h = mix(h ^ s[:, :, j]) + s[:, :, j]
    return h.astype(np.int64)


def _digest(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Order-free 128-bit digest of each row's set."""
    sizes = np.diff(at).astype(np.uint64)
    out = np.empty((len(sizes), 2), np.uint64)
    for j, salt in enumerate((np.uint64(0x51ED270B), np.uint64(0xC2B2AE3D27D4EB4F))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ salt) * (salt | np.uint64(1)), dtype=np.uint64)])
        out[:, j] = mix((total[at[1:]] - total[at[:-1]]) ^ sizes)
    return pa.Array.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _rows(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(matrix.ravel()))


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = _second_permutation(bands * rows)
        for batch in batches:
            for a, b, w in word_slices(batch.column("text"), lower=True):
                values, at = shingles(w, k)
                keys = band_keys(signatures(values, at, bands * rows, view), bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("rid").slice(a, b - a), pa.array(np.diff(at)), _digest(values, at), _rows(keys)], names=["doc_id", "rid", "n", "cid", "bands"])

    return lean(run)


def least_agreement(width: int, percent: int) -> int:
    """Coordinates that agree at the limit, less four standard deviations (a miss of 3 in 100,000)."""
    j = percent / 100
    return math.floor(width * j - 4 * math.sqrt(width * j * (1 - j)))


def _confirm(k: int, percent: int):
    """Exact test of candidate pairs on the full sets of both texts, a bounded part of the pairs at a time."""

    def test(part: pa.RecordBatch) -> np.ndarray:
        n = part.num_rows
        both = pa.concat_arrays([part.column("text_a").cast(pa.large_string()), part.column("text_b").cast(pa.large_string())])
        order = pa.array(np.arange(2 * n).reshape(2, n).T.ravel())  # a pair's texts side by side
        sets = [shingles(w, k) for _, _, w in word_slices(both.take(order), lower=True)]
        values = np.concatenate([v for v, _ in sets])
        sizes = np.concatenate([np.diff(at) for _, at in sets]).reshape(-1, 2).sum(1)
        pair = np.repeat(np.arange(n), sizes)
        order = np.lexsort((values, pair))
        v, p = values[order], pair[order]
        twice = np.flatnonzero((v[1:] == v[:-1]) & (p[1:] == p[:-1]))
        shared = np.bincount(p[twice], minlength=n)
        union = sizes - shared
        return (100 * shared >= percent * union) & (union > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(np.diff(utf8(batch.column(c))[1]) for c in ("text_a", "text_b"))
            part = np.cumsum(size) // AT_ONCE
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
            for a, b in zip(edges[:-1], edges[1:]):
                linked = test(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("a").slice(a, b - a), batch.column("b").slice(a, b - a), pa.array(linked)], names=["a", "b", "linked"])

    return lean(run)


def _coordinates(k: int, bands: int, rows: int):
    """Band keys and signatures cut to a byte a coordinate (enough for counting how many agree), beside the text."""
    width = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = _second_permutation(width)
        for batch in batches:
            for a, b, w in word_slices(batch.column("text"), lower=True):
                values, at = shingles(w, k)
                whole = signatures(values, at, width, view)
                cols = [pa.Array.from_buffers(pa.binary(x.shape[1] * x.itemsize), b - a, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (band_keys(whole, bands, rows), whole.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(np.diff(at)), *cols, batch.column("text").slice(a, b - a)], names=["node", "n", "keys", "low", "text"])

    return lean(run)


class _Side:
    """One block of a bucket's members: roots, set sizes, band keys, signatures; full sets of those that are asked for."""

    def __init__(self, members: pa.StructArray, k: int, bands: int):
        def matrix(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(members.field(name).to_pylist()), kind).reshape(len(members), -1)

        self.root, self.size = members.field("root").to_numpy(), members.field("n").to_numpy()
        self.keys, self.low = matrix("keys", np.int64), matrix("low", np.uint8)
        self.k, self.texts, self.known = k, members.field("text"), {}

    def sets(self, rows: np.ndarray) -> list[np.ndarray]:
        new = [i for i in rows.tolist() if i not in self.known]
        done = 0
        for _, _, w in word_slices(self.texts.take(pa.array(new, pa.int64())), lower=True):
            values, at = shingles(w, self.k)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                self.known[new[done]] = values[x:y]
                done += 1
        return [self.known[i] for i in rows.tolist()]


def _shared(a: _Side, x: np.ndarray, b: _Side, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x of a with sets y of b."""
    left, right = np.concatenate(a.sets(x)), np.concatenate(b.sets(y))
    common = np.intersect1d(left, right)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(common):
        return out.astype(np.int64)

    def places(v: np.ndarray, side: _Side, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, v)
        at[at == len(common)] = 0
        good = common[at] == v
        return np.repeat(np.arange(len(rows)), side.size[rows])[good], at[good]

    (r, c), (s, d) = places(left, a, x), places(right, b, y)
    for first in range(0, len(common), 4096):
        m, w = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        for table, row, col in ((m, r, c), (w, s, d)):
            own = (col >= first) & (col < first + 4096)
            table[row[own], col[own] - first] = 1
        out += m @ w.T
    return out.astype(np.int64)


def _joins(k: int, percent: int, bands: int, rows: int):
    """Links that join different components, of every pair (one of each block) whose first shared band is the bucket."""
    least = least_agreement(bands * rows, percent)

    def links(bucket: int, a: _Side, b: _Side) -> list[tuple[int, int]]:
        apart = a.root[:, None] != b.root[None, :]
        near = (100 * np.minimum(a.size[:, None], b.size[None, :]) >= percent * np.maximum(a.size[:, None], b.size[None, :])) & apart
        for j in range(bands):
            same = a.keys[:, j][:, None] == b.keys[:, j][None, :]
            if (a.keys[:, j] == bucket).any() and (b.keys[:, j] == bucket).any():
                near &= same
                break
            near &= ~same
        if not near.any():
            return []
        agree = np.zeros(near.shape, np.int16)
        for j in range(bands * rows):
            agree += a.low[:, j][:, None] == b.low[:, j][None, :]
        near &= agree >= least
        x, y = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(x):
            return []
        shared = _shared(a, x, b, y)
        union = a.size[x][:, None] + b.size[y][None, :] - shared
        at, bt = np.nonzero(near[np.ix_(x, y)] & (100 * shared >= percent * union))
        own: dict[int, int] = {}

        def top(r: int) -> int:
            while own.get(r, r) != r:
                r = own[r]
            return r

        out = []
        for p, q in set(zip(a.root[x[at]].tolist(), b.root[y[bt]].tolist(), strict=True)):
            u, v = top(p), top(q)
            if u != v:
                own[max(u, v)] = min(u, v)
                out.append((min(p, q), max(p, q)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, other = _Side(batch.column("left")[i].values, k, bands), batch.column("right")[i]
                b = _Side(other.values, k, bands) if other.is_valid else a  # a block with itself
                found = links(batch.column("bucket")[i].as_py(), a, b)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return lean(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges(a, b)`` by alternating large and small stars, until they settle.

    root is the smallest node of the component. Each star is a partial aggregation and a
    join of two tables, which Spark can split at a node with very many neighbours; edges
    stay distributed. Rounds grow with the logarithm of a component's longest path."""
    e = keep(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    was = None
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.selectExpr("u", "m AS v")).distinct()
        before, e = e, keep(small, "edges")
        drop(before, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return e.selectExpr("u AS node", "v AS root").unionByName(e.selectExpr("v AS node", "v AS root").distinct())
        was = now


def text_key(text: Column) -> Column:
    """128 bits by which equal texts are told."""
    return F.unhex(F.md5(text))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, rid (digest of the text), root (of the component, null without words)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", text_key(F.col("text")))
    kind = own.schema["doc_id"].dataType.simpleString()
    sketch = keep(own.mapInArrow(_sketch(k, bands, rows), f"doc_id {kind}, rid binary, n bigint, cid binary, bands array<bigint>"), "sketch")
    # a class of equal sets is called by a number of its own; the written table fixes it
    classes = sketch.where("n > 0").groupBy("cid").agg(F.first(F.struct("rid", "bands")).alias("x"), F.min("doc_id").alias("least_id"))
    classes = keep(classes.select("cid", "x.rid", "x.bands", "least_id").withColumn("node", F.monotonically_increasing_id()), "classes")
    member = classes.select("node", F.explode("bands").alias("bucket"))
    # what is known of a bucket is written before it's joined: Spark splits a large bucket only in a join of plain shuffles
    sizes = keep(member.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    common = keep(member.join(sizes, "bucket"), "shared")
    # the least edited copy has the band keys that most others have: it makes the best pivot
    central = keep(common.groupBy("node").agg(F.sum("c").alias("weight")), "central")
    weighed = keep(common.drop("c").join(central, "node"), "shared")
    pivots = keep(weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("m")).select("bucket", F.col("m.node").alias("p")), "pivots")
    shared = keep(weighed.drop("weight").join(pivots, "bucket"), "shared")
    drop(sizes, common, weighed, pivots)

    # equal texts meet before the shuffle; one text of each class with company stays
    company = keep(central.select("node").join(classes.select("node", "rid"), "node"), "company")
    texts = own.where("text IS NOT NULL").groupBy("rid").agg(F.first("text").alias("text"))
    texts = keep(texts.join(company, "rid").select("node", "text"), "texts")
    drop(central, company)

    stars = shared.where("node <> p").selectExpr("least(p, node) AS a", "greatest(p, node) AS b").distinct()
    pairs = stars.join(texts.selectExpr("node AS a", "text AS text_a"), "a").join(texts.selectExpr("node AS b", "text AS text_b"), "b")
    tested = keep(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a bigint, b bigint, linked boolean"), "tested")
    parts = keep(components(tested.where("linked")), "parts")
    drop(tested)

    # what the stars left apart: blocks of a bucket's members, where those are in different components
    named = keep(shared.select("bucket", "node").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    drop(shared)
    open_ = keep(named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).where("x <> y AND c > 2").select("bucket", "c"), "open")
    apart = keep(named.join(open_, "bucket"), "apart")
    coordinates = texts.join(apart.select("node").distinct(), "node", "left_semi").select("node", "text")
    coordinates = keep(coordinates.mapInArrow(_coordinates(k, bands, rows), "node bigint, n bigint, keys binary, low binary, text string"), "coordinates")
    weight = keep(coordinates.select("node", F.octet_length("text").alias("b")), "weight")
    weight = apart.join(weight, "node").groupBy("bucket").agg(F.max("c").alias("c"), F.sum("b").alias("b"))
    dealt = keep(weight.select("bucket", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int").alias("blocks")), "dealt")
    member = keep(apart.drop("c").join(dealt, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dealt")
    blocks = member.join(coordinates, "node").groupBy("bucket", "blocks", "i").agg(F.collect_list(F.struct("root", "n", "keys", "low", "text")).alias("members"))
    blocks = keep(blocks, "blocks")
    left = blocks.select("bucket", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"), F.col("members").alias("left"))
    right = blocks.where("i > 0").select("bucket", F.explode(F.expr("sequence(0, i - 1)")).alias("i"), F.col("i").alias("j"), F.col("members").alias("right"))
    more = keep(left.join(right, ["bucket", "i", "j"], "left").select("bucket", "left", "right").mapInArrow(_joins(k, percent, bands, rows), "a bigint, b bigint"), "more")
    joined = keep(components(more), "joined")  # of roots
    drop(named, open_, apart, coordinates, member, blocks, more, texts)

    final = parts.join(joined.selectExpr("node AS root", "root AS r"), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
    final = final.unionByName(joined.join(parts, "node", "left_anti").select("node", "root"))  # classes that the stars linked with nothing
    known = keep(classes.select("cid", "node", "least_id").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    least = keep(known.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    drop(parts, joined, classes)
    by_class = known.select("cid", "root").join(least, "root")
    out = sketch.select("doc_id", "rid", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(by_class, "cid", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid", "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all columns: of each near-duplicate group one row.

    That is the row of the smallest doc_id, of several such (repeated rows, or versions under
    one doc_id) one of them. Documents without words are linked with nothing and all stay.
    The columns of docs may have any names."""
    found = near_duplicates(docs, **options).where("kept AND root IS NOT NULL")
    one = keep(found.groupBy("root", "doc_id").agg(F.min("rid").alias("rid"), F.count("*").alias("n")).select("doc_id", "rid", "n"), "one")
    whole = docs.select(F.struct(*docs.columns).alias("row")).withColumn("rid", text_key(F.col("row.text")))
    joined = whole.join(one, F.col("row.doc_id").eqNullSafe(one["doc_id"]) & (whole["rid"] == one["rid"])).select("row", whole["rid"].alias("rid"), "n")
    single = joined.where("n = 1").select("row.*")
    several = joined.where("n > 1").groupBy("row.doc_id", "rid").agg(F.first("row").alias("row")).select("row.*")
    wordless = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return single.unionByName(several).unionByName(wordless)
