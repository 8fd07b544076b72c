"""Token counts through a cache keyed by content digest and tokenizer-version digest.

Texts are joined by digest to stored counts; of the texts without a count each distinct one
is encoded once, by the tokenizer's own library, and the counts are appended to the cache.
Equal texts meet in a partial aggregation before the shuffle, so a group of copies of any
size costs one text per map task. The appended part is read back for the answer, so a lost
executor repeats lookups, not encodings.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each get their
count; an empty table appends nothing; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomtext.llm._spark import keep, lean

ROWS_AT_ONCE = 64
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts as the file's library gives them, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(e.encode_ordinary(t)) for t in texts]


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                n = np.array(count(part.column("text").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), part.column("digest"), pa.array(n)], names=["tokenizer", "digest", "n_tokens"])

    return lean(run)


def count_tokens(docs: DataFrame, path: str, cache: DataFrame | None = None, limit: int = 4096, normalise: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counts, appended): doc_id, n_bytes, n_tokens, over_limit, digest per row; and the new cache rows, already written.

    normalise: a Column function applied to the text first, the identity by default (counts are then the library's own)."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    own = own.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    stored = (cache if cache is not None else spark.createDataFrame([], CACHE_SCHEMA)).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    missing = own.join(stored, "digest", "left_anti") if cache is not None else own
    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))
    appended = keep(distinct.mapInArrow(_encode(path, version), CACHE_SCHEMA), "token_counts")
    known = stored.unionByName(appended.select("digest", "n_tokens")) if cache is not None else appended.select("digest", "n_tokens")
    rows = own.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
    out = rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
    return out, appended


def count_through(docs: DataFrame, path: str, cache_path: str, limit: int = 4096, normalise: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts as of count_tokens, through the cache in the folder cache_path: it is read, only texts without a count
    are encoded, and their counts are appended to it. The folder is made where there is none; one writer at a time
    is best (two may append the same digest, which is read once)."""
    spark = docs.sparkSession
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)  # its files are those of now: later appends aren't seen
    counts, appended = count_tokens(docs, path, stored, limit, normalise, id_col, text_col)
    appended.write.mode("append").parquet(cache_path)
    return counts
