"""Embedding a DataFrame: micro-batches, one-by-one fallback, errors as data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomtext.functions.errors import PermanentError, chain
from fathomtext.sources.embedders import Embedder

BATCH = 25
_USAGE = pa.list_(pa.struct([("model", pa.string()), ("inputs", pa.int32()), ("bytes", pa.int64()), ("tokens", pa.int64()), ("max_tokens", pa.int32()), ("clipped", pa.bool_())]))
_ERROR = pa.struct([("index", pa.int32()), ("message", pa.string()), ("batch_cause", pa.string()), ("permanent", pa.bool_()), ("too_long", pa.bool_())])


def _failure(index: int, error: Exception, cause: Exception | None) -> dict:
    own = [e for e in chain(error) if isinstance(e, PermanentError)]
    return {"index": index, "message": str(error), "batch_cause": str(cause) if cause else None, "permanent": bool(own), "too_long": any(e.too_long for e in own)}


def embed_batch(e: Embedder, texts: list[str], first: int = 0, usage: list | None = None) -> list[tuple[list[float] | None, dict | None]]:
    """(vector, error) of each text: the batch, or else each text alone. usage: gets (place, row) of each request."""
    usage = [] if usage is None else usage
    cause: Exception
    try:
        vectors = e.embed(texts)
        if len(vectors) == len(texts):
            return [(v, None) for v in vectors]
        cause = RuntimeError(f"embedding: short batch: {len(vectors)} vectors for {len(texts)} inputs")
    except Exception as error:
        cause = error
    finally:
        usage += [(0, row) for row in e.take_usage()]
    out: list[tuple[list[float] | None, dict | None]] = []
    for i, t in enumerate(texts):
        try:
            own = e.embed([t])
            usage += [(i, row) for row in e.take_usage()]
            if len(own) != 1 or own[0] is None:
                raise RuntimeError("embedding: no vector")
            out.append((own[0], None))
        except Exception as error:
            usage += [(i, row) for row in e.take_usage()]
            out.append((None, _failure(first + i, error, cause)))
    return out


def embed_all(e: Embedder, texts: list[str], size: int = BATCH, progress=None) -> list[list[float]]:
    """The vectors of all texts; the first failure ends it."""
    out: list = []
    for a in range(0, len(texts), size if size > 0 else BATCH):
        part = texts[a : a + (size if size > 0 else BATCH)]
        vectors = e.embed(part)
        if len(vectors) != len(part):
            raise RuntimeError(f"embedding: short batch: {len(vectors)} vectors for {len(part)} inputs")
        out += vectors
        if progress:
            progress(len(out), len(texts))
    return out


def batch_results(e: Embedder, texts: list[str], size: int = BATCH, progress=None) -> list[tuple[list[float] | None, dict | None]]:
    """Results aligned with the texts; it raises only if every text failed."""
    size = size if size > 0 else BATCH
    out: list = []
    for a in range(0, len(texts), size):
        out += embed_batch(e, texts[a : a + size], a)
        if progress:
            progress(len(out), len(texts))
    if texts and all(x for _, x in out):
        raise RuntimeError(f"embedding: all {len(texts)} inputs failed: {out[0][1]['message']}")
    return out


def _run(e: Embedder, size: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                texts = part.column("text").to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                got: list = [(None, None)] * len(texts)
                spent: list[tuple[int, dict]] = []
                usage: list[list[dict]] = [[] for _ in texts]
                for i, r in zip(there, embed_batch(e, [texts[i] for i in there], 0, spent) if there else (), strict=True):
                    got[i] = r
                for i, row in spent:
                    usage[there[i]].append(row)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([x for _, x in got], _ERROR), pa.array(usage, _USAGE)], names=[key, "vector", "error", "usage"])

    return run


def embed_df(df: DataFrame, e: Embedder, key: str = "row_id", text: str = "text", size: int = BATCH, deterministic: bool = False) -> DataFrame:
    """key, vector, error, usage of every row; null text gives neither vector nor error.

    usage has the rows of the requests that a row began: those of a batch stand at its first row.

    deterministic: rows are dealt by a hash of the key and sorted, so batch edges are the same in every run
    with as many partitions. Only the two columns travel."""
    own = df.select(F.col(key), F.col(text).alias("text"))
    if deterministic:
        own = own.repartition(key).sortWithinPartitions(key)
    kind = df.schema[key].dataType.simpleString()
    return own.mapInArrow(_run(e, size, key), f"`{key}` {kind}, vector array<float>, error struct<index:int,message:string,batch_cause:string,permanent:boolean,too_long:boolean>, usage array<struct<model:string,inputs:int,bytes:bigint,tokens:bigint,max_tokens:int,clipped:boolean>>")


def usage_log(results: DataFrame, seq: str = "row_id") -> DataFrame:
    """seq, model, inputs, bytes, tokens, max_tokens, clipped of every request: what ``usage.calibration`` takes."""
    return results.select(F.col(seq).alias("seq"), F.explode("usage").alias("u")).select("seq", "u.*")


def progress(results: DataFrame) -> DataFrame:
    """done, failed, rows and tokens of embedded results."""
    tokens = F.aggregate(F.transform("usage", lambda u: u["tokens"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return results.agg(F.count_if(F.col("vector").isNotNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("rows"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def all_failed(results: DataFrame) -> bool:
    """Whether there are rows and none has a result."""
    r = results.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("good")).first()
    return r.n > 0 and r.good == 0
