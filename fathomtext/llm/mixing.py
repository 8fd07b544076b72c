"""Mixing sources to target weights by Pareto order sampling.

Every source has a share of the mix (weights cycle over the sources in code point order),
capped at a multiple of its own size with the excess shared again. Within a source a
document's expected copies are in proportion to the bits of its number of words (1 for one
word, 11 for two thousand), so longer documents are likelier, but never above ``MOST_COPIES``;
the factor is solved so that expected words are the source's target. The whole part of the
copies is taken for certain. For the rest documents are ranked by random odds divided by
their own inclusion odds (the Pareto order), across all lengths, and taken from the smallest
on until the fixed size, the source's remaining words, is reached as nearly as a whole
document allows. Random numbers are digests of (seed, doc_id, text), so reruns agree on any
layout of the rows.

The cut is found without sorting rows: a rank is a 48-bit key, and for 16 bits at a time
the words of each (source, bits) cell are summed, the cell that crosses the target is
entered, and only its rows go to the next step. Each step is a partial aggregation to at
most 65536 cells a source. Equal rows that meet at the cut are counted and split by number.
All of that reads one narrow table (id, source, size, random number); the small tables of
rates and cuts are joined without a hint, so Spark broadcasts them only below its own limit.

Defined cases: a null source is a source of its own, last in order; null or wordless text
has size 0 and isn't taken; of repeated rows each counts; an empty table gives an empty
result; other columns, whatever their names, are only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.llm._spark import drop, keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
STEPS, CELL = 3, 16
KEY_BITS = STEPS * CELL
RUN = 1 << 12  # copies of one row that are unfolded in one go


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _level(total: Column, cap: Column, weight: Column, ratio: str, part: list[str], tie: list[Column]) -> Column:
    """The level c with sum of least(cap, c * weight) = total over ``part``: the end of sharing the excess again and again."""
    order = Window.partitionBy(*part).orderBy(ratio, *tie)
    done = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    return (total - done) / left


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = F.col("source").asc_nulls_last()
    place = F.row_number().over(Window.orderBy(last))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_ = Window.partitionBy()
    s = s.withColumn("level", _level(F.sum("source_size").over(all_) * F.lit(float(share)), F.col("cap"), F.col("weight"), "ratio", [], [last]))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_)["level"], F.max("ratio").over(all_))
    return s.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _bits(size: Column) -> Column:
    return F.length(F.bin(size))


def _random(seed: int, doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def _by_source(big: DataFrame, small: DataFrame, *more: str) -> DataFrame:
    """big with the columns of small, joined by source (null is a source) and ``more``."""
    own = small.select(F.col("source").alias("__s"), *(F.col(c).alias(f"__{c}") for c in more), *(c for c in small.columns if c not in ("source", *more)))
    on = F.col("source").eqNullSafe(F.col("__s"))
    for c in more:
        on &= F.col(c) == F.col(f"__{c}")
    return big.join(own, on).drop("__s", *(f"__{c}" for c in more))


def rates(sizes: DataFrame, targets: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """(source, bits, whole, part, words): expected copies of the documents of each length class, as whole copies and inclusion odds."""
    c = sizes.where("size > 0").groupBy("source", _bits(F.col("size")).alias("bits")).agg(F.sum("size").alias("words"))
    c = _by_source(c, targets.select("source", "target")).withColumn("ratio", F.lit(float(most)) / F.col("bits"))
    c = c.withColumn("level", _level(F.col("target"), F.col("words") * F.lit(float(most)), F.col("words") * F.col("bits").cast("double"), "ratio", ["source"], []))
    own = Window.partitionBy("source")
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(own)["level"], F.max("ratio").over(own))
    c = c.withColumn("copies", F.least(F.lit(float(most)), level * F.col("bits")))
    return c.select("source", "bits", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("part"), "words")


def _key() -> Column:
    """The Pareto rank as a whole number, from columns u and part; null where nothing is left to draw."""
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    return F.when(F.col("part") > 0, F.floor(q / (1 + q) * F.lit(float(1 << KEY_BITS))).cast("bigint"))


def _cuts(ranks: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, cut, need): ranks below the cut are taken; need is what is left for the rank at the cut."""
    at = needs.withColumn("cut", F.lit(0).cast("bigint"))
    for i in range(STEPS):
        inside = _by_source(ranks, at).where(F.shiftright("key", KEY_BITS - CELL * i) == F.col("cut"))
        cells = inside.groupBy("source", F.shiftright("key", KEY_BITS - CELL * (i + 1)).alias("cell")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("cell")))
        over = cells.where("upto > need").groupBy("source").agg(F.min(F.struct("cell", "upto", "words")).alias("x"))
        over = over.select(F.col("source").alias("__s"), F.col("x.cell").alias("cell"), (F.col("x.upto") - F.col("x.words")).alias("before"))
        new = at.join(over, F.col("source").eqNullSafe(F.col("__s")), "left")
        # without such a cell all rows go in
        new = new.select("source", (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"), F.coalesce("cell", F.lit((1 << CELL * (i + 1)) if i == 0 else None).cast("bigint"), F.shiftleft("cut", CELL)).alias("cut"))
        before, at = at, keep(new, "cuts")
        if i:
            drop(before)
    return at


def _plan(narrow: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, rates, cuts) from rows (source, size, u)."""
    most = options.get("most", MOST_COPIES)
    targets = keep(source_targets(narrow.select("source", "size"), **options), "targets")
    rate = keep(rates(narrow.select("source", "size"), targets, most), "rates")
    sure = rate.groupBy("source").agg(F.sum(F.col("whole") * F.col("words")).alias("sure"))
    needs = keep(_by_source(targets.select("source", "target"), sure).select("source", (F.col("target") - F.col("sure")).alias("need")), "needs")
    ranks = _by_source(narrow.where("size > 0").select("source", "size", "u", _bits(F.col("size")).alias("bits")), rate.select("source", "bits", "part"), "bits")
    ranks = keep(ranks.select("source", "size", _key().alias("key")).where("key IS NOT NULL"), "ranks")
    cuts = _cuts(ranks, needs)
    drop(needs, ranks)
    return targets, rate, cuts


def _decided(rows: DataFrame, rate: DataFrame, cuts: DataFrame, order: list[Column]) -> DataFrame:
    """rows(doc_id, source, size, u, row) with times; rows at the cut are counted, split by number and unfolded."""
    rows = rows.withColumn("bits", _bits(F.col("size")))
    empty = rows.where("size = 0").withColumn("times", F.lit(0))
    d = _by_source(_by_source(rows.where("size > 0"), rate.select("source", "bits", "whole", "part"), "bits"), cuts).withColumn("key", _key())
    off = F.coalesce(F.col("key") != F.col("cut"), F.lit(True))
    names = [*rows.columns, "times"]
    plain = d.where(off).withColumn("times", (F.col("whole") + F.coalesce((F.col("key") < F.col("cut")).cast("int"), F.lit(0))).cast("int")).select(names)
    tied = d.where(~off).groupBy(*rows.columns, "whole", "need").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)))
    # of n equal rows so many that the words taken come nearest to what is needed
    tied = tied.withColumn("more", F.least(F.greatest(F.ceil((F.col("need") - F.col("before")) / F.col("size") + 0.5) - 1, F.lit(0)), F.col("n")))
    tied = unfold(tied, "n").withColumn("times", (F.col("whole") + (F.col("copy") < F.col("more")).cast("int")).cast("int")).select(names)
    return empty.select(names).unionByName(plain).unionByName(tied)


def unfold(folded: DataFrame, count: str) -> DataFrame:
    """Each row as often as its column ``count`` says, numbered from 0 in column copy; a large count is dealt to many tasks."""
    few = folded.where(F.col(count) <= RUN).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)))
    many = folded.where(F.col(count) > RUN).withColumn("__start", F.explode(F.expr(f"sequence(0L, `{count}` - 1, {RUN}L)")))
    many = many.repartition("__start").withColumn("copy", F.explode(F.expr(f"sequence(__start, least(__start + {RUN - 1}, `{count}` - 1))"))).drop("__start")
    return few.unionByName(many)


def mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and times (how often the mix takes it) of every row; reads the texts once."""
    narrow = keep(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), _random(seed, F.col("doc_id"), F.col("text")).alias("u")), "sizes")
    targets, rate, cuts = _plan(narrow, **options)
    order = [F.col("doc_id").asc_nulls_last(), F.col("u")]
    done = _decided(narrow, rate, cuts, order)
    return _by_source(done, targets).select("doc_id", "source", "size", "source_size", "target", "times")


def mixed_rows(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    whole = whole.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), words_in(F.col("row.text")).alias("size"), _random(seed, F.col("row.doc_id"), F.col("row.text")).alias("u"), "row")
    narrow = keep(whole.drop("row"), "sizes")
    _, rate, cuts = _plan(narrow, **options)
    order = [F.col("doc_id").asc_nulls_last(), F.col("u"), F.xxhash64("row")]
    done = _decided(whole, rate, cuts, order).where("times > 0")
    drop(narrow)
    return done.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("__copy")).select("row.*")
