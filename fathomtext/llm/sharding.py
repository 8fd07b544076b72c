"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of a digest of (id, size, checksum); the permutation of
[0, n) is a Feistel network over a grid of a x b >= n cells with cycle walking, and the
shard is the permuted number modulo the shard count, the slot its quotient. So shard and
slot of a number can be computed, and counts of shards differ by one at most.

Only narrow keys travel. Equal keys are counted before the shuffle and numbered as a run,
so repeated rows never meet in one task; digest prefixes make 4096 even buckets whose
counts (at most 4096 rows) give the buckets' first numbers. ``sharded_rows`` gives the rows
themselves with their places: texts are shuffled once, equal rows folded before that.

Defined cases: a null id or text has its own digest (size 1, checksum of no bytes); equal
rows get the numbers of one run, which of them gets which doesn't show; an empty table
gives an empty result. Nothing but the id and the text is looked at; other columns only
tell versions of one id and text apart in ``sharded_rows``, where a column of docs that is
called like one of the result's is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.llm._spark import keep
from fathomtext.llm.mixing import unfold

ROUNDS = 6
WALK = 64
PLACED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _round_value(seed: int, i: Column, half: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def feistel(x: Column, a: Column, b: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """A bijection of [0, a * b): halves x div b and x mod b are moved in turn, modulo a and b."""

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _round_value(seed, i, s["r"]), a)
        right = F.pmod(s["r"] + _round_value(seed, i, s["l"]), b)
        return F.struct(F.when(i % 2 == 1, left).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, s["r"]).otherwise(right).alias("r"))

    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """Feistel with cycle walking onto [0, n). At most a - 1 cells are beyond n, so a walk is
    shorter than that, and longer than WALK only with probability n ** -(WALK / 2)."""
    once = feistel(x, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda y, i: F.when(y < n, y).otherwise(feistel(y, a, b, seed)))
    out = F.when(once < n, once).otherwise(walked)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("bigint"))


def _size_and_sum(text: Column) -> list[Column]:
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return [(F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32")]


def _digest() -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32"))


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *_size_and_sum(F.col(text_col)))


def number_rows(k: DataFrame) -> DataFrame:
    """Distinct rows of k (doc_id, size, text_crc32 and any more that tell rows apart) with h (their digest), first (their first global number), n (copies) and total."""
    g = k.groupBy(*k.columns).agg(F.count("*").alias("n"))
    g = g.withColumn("h", _digest()).withColumn("bucket", F.substring("h", 1, 3))
    counts = g.groupBy("bucket").agg(F.sum("n").alias("c"))  # at most 4096 rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy()).alias("total"))
    w = Window.partitionBy("bucket").orderBy("h", *k.columns).rowsBetween(Window.unboundedPreceding, -1)
    return g.join(F.broadcast(counts), "bucket").withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0)))


def _placed(g: DataFrame, shards: int, seed: int) -> DataFrame:
    """Numbered rows unfolded, with row_number, place and the columns of PLACED."""
    g = unfold(g, "n").withColumn("row_number", F.col("first") + F.col("copy"))
    g = g.withColumn("a", F.ceil(F.sqrt(F.col("total"))).cast("bigint")).withColumn("b", F.ceil(F.col("total") / F.col("a")).cast("bigint"))
    g = g.withColumn("place", permute(F.col("row_number"), F.col("total"), F.col("a"), F.col("b"), seed))
    return g.withColumn("law", F.lit("rows")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("bigint")).withColumn("grown_shard", F.lit(None).cast("int"))


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, place for every row."""
    return _placed(number_rows(keys(docs, id_col, text_col)), shards, seed).select("doc_id", *PLACED, "row_number", "place")


def sharded_rows(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """The rows of docs, all columns, each with size, text_crc32, law, shard, slot and grown_shard."""
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    whole = whole.select(F.col("row.doc_id").alias("doc_id"), *_size_and_sum(F.col("row.text")), F.xxhash64("row").alias("version"), "row")
    numbered = keep(number_rows(whole.drop("row")), "numbered").select("h", "version", "size", "text_crc32", "n", "first", "total")
    # a digest and the version name a row, so that the fold and the join share one shuffle of the texts
    folded = whole.withColumn("h", _digest()).groupBy("h", "version").agg(F.first("row").alias("row"))
    placed = _placed(folded.join(numbered, ["h", "version"]), shards, seed)
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in PLACED), *PLACED)
