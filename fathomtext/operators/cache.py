"""Query cache as a table: hits by join, misses embedded and appended, the most recent kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.functions.text import cache_key, normalize_query
from fathomtext.operators.embed import embed_df
from fathomtext.sources.embedders import Embedder, embed_with_retry
from fathomtext.sources.tables import keep

CACHE = "key string, vector array<float>, last_used bigint"


def keyed(queries: DataFrame, model: str, dim: int, text: str = "text") -> DataFrame:
    return queries.withColumn("key", cache_key(F.lit(model), F.lit(dim), F.col(text)))


def split_cached(queries: DataFrame, cache: DataFrame, model: str, dim: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with vector, misses) of the queries; the cache is joined, never collected."""
    own = keyed(queries, model, dim, text)
    stored = cache.select("key", "vector")
    return own.join(stored, "key"), own.join(stored, "key", "left_anti")


def embed_cached(queries: DataFrame, cache: DataFrame, e: Embedder, dim: int, now: int, key: str = "row_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key column, vector, cached) of every query, and the rows to append to the cache.

    Raw texts are embedded, once: what they give is written before the two results are made of it.
    Variants of one query share a key, and the last of them is stored. A null query has no vector."""
    hits, misses = split_cached(queries, cache, e.model, dim, text)
    asked = keep(misses.select(F.struct(F.col(key).alias("k"), normalize_query(F.col(text)).alias("q")).alias("id"), F.col(text).alias("text")), "misses")
    found = keep(embed_df(asked, e, "id").select(F.col("id.k").alias(key), F.col("id.q").alias("q"), "vector"), "embedded")
    # the cache was asked by the dimension that is expected; what is stored goes by the vectors' own
    named = found.where("vector IS NOT NULL").withColumn("key", F.concat(F.lit(e.model), F.lit("\0"), F.size("vector").cast("string"), F.lit("\0"), "q"))
    append = named.groupBy("key").agg(F.max_by("vector", key).alias("vector")).withColumn("last_used", F.lit(now).cast("bigint"))
    out = hits.select(key, "vector", F.lit(True).alias("cached")).unionByName(found.select(key, "vector", F.lit(False).alias("cached")))
    return out, append


def evict(cache: DataFrame, capacity: int) -> DataFrame:
    """The most recently used entries: a limit of a sort, so no single task sees the whole cache."""
    latest = cache.groupBy("key").agg(F.max_by("vector", "last_used").alias("vector"), F.max("last_used").alias("last_used"))
    return latest.orderBy(F.desc("last_used"), "key").limit(capacity) if capacity > 0 else latest.limit(0)


class QueryCache:
    """A small recency-bounded cache for single queries on the driver; capacity 0 or less passes everything on."""

    def __init__(self, capacity: int):
        self.capacity, self.rows = capacity, {}

    @staticmethod
    def _normal(text: str) -> str:
        from fathomtext.operators.tokens import _WORD

        return " ".join(_WORD.findall("".join(c.lower() if c != "İ" else "i" for c in text)))

    def _key(self, e: Embedder, text: str) -> str:
        return "\0".join((e.fingerprint[0], str(e.fingerprint[1]), self._normal(text)))

    def single(self, e: Embedder, text: str) -> list[float]:
        return self.embed(e, [text])[0]

    def embed(self, e: Embedder, texts: list[str]) -> list[list[float] | None]:
        if self.capacity <= 0:
            return embed_with_retry(e, texts)
        out: list = [None] * len(texts)
        missing = []
        for i, t in enumerate(texts):
            k = self._key(e, t)
            if k in self.rows:
                self.rows[k] = out[i] = self.rows.pop(k)
            else:
                missing.append(i)
        if missing:
            for i, v in zip(missing, embed_with_retry(e, [texts[i] for i in missing]), strict=False):
                out[i] = v
                k = self._key(e, texts[i])
                self.rows.pop(k, None)
                self.rows[k] = v
                while len(self.rows) > self.capacity:
                    del self.rows[next(iter(self.rows))]
        return out

    def __len__(self) -> int:
        return len(self.rows)


