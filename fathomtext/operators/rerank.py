"""Reranking: requests of at most 256 documents, ranks by window, first-stage order where it is unavailable."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.functions.errors import PermanentError, RerankUnavailable, rerank_http_error
from fathomtext.functions.models import DEFAULT, Registry
from fathomtext.operators.budget import limit_documents
from fathomtext.operators.tokens import back_up
from fathomtext.sources.config import JINA, TEI, RerankConfig
from fathomtext.sources.http import Timeouts, post

MOST = 256
NO_BUDGET = 1 << 62


class Reranker(ABC):
    model: str = ""

    @abstractmethod
    def rerank(self, query: str, documents: list[str], top_n: int = 0, instruction: str = "", max_document_bytes: int = 0) -> list[tuple[int, float]]:
        """(index, score), best first; ties in the order of the answers."""


class JinaReranker(Reranker):
    def __init__(self, base_url: str, model: str, api_key: str = "", strict: bool = False, timeouts: Timeouts = Timeouts()):
        self.base_url, self.model, self.api_key, self.strict, self.timeouts = base_url.rstrip("/"), model, api_key, strict, timeouts

    def rerank(self, query: str, documents: list[str], top_n: int = 0, instruction: str = "", max_document_bytes: int = 0) -> list[tuple[int, float]]:
        if not documents:
            return []
        most = max_document_bytes if max_document_bytes > 0 else DEFAULT.lookup_limits(self.model).max_bytes
        documents = [self._bound(d, i, most) for i, d in enumerate(documents)]
        query = f"{instruction}\n{query}" if instruction else query
        found: list[tuple[int, float]] = []
        for a in range(0, len(documents), MOST):
            found += [(a + i, s) for i, s in self._send(query, documents[a : a + MOST])]
        found.sort(key=lambda x: -x[1])
        return found[:top_n] if top_n > 0 else found

    def _bound(self, d: str, i: int, most: int) -> str:
        raw = d.encode()
        if most <= 0 or len(raw) <= most:
            return d
        if self.strict:
            raise PermanentError(f"rerank: document {i} exceeds {self.model} MaxBytes ({len(raw)} > {most})")
        return raw[: back_up(raw, most)].decode("utf-8", "replace")

    def _send(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        try:
            answer = post(f"{self.base_url}/v1/rerank", {"model": self.model, "query": query, "documents": documents}, self.timeouts.budget(len(documents)), rerank_http_error, self.api_key)
        except OSError as e:
            raise RerankUnavailable(str(e)) from e
        out = []
        for r in answer.get("results") or []:
            if not 0 <= r["index"] < len(documents):
                raise RuntimeError(f"rerank: index {r['index']} out of range for {len(documents)} documents")
            out.append((r["index"], float(r["relevance_score"])))
        return out


class Normalizing(Reranker):
    """Scores through the logistic function; the order stays."""

    def __init__(self, inner: Reranker):
        self.inner, self.model, self.strict = inner, inner.model, getattr(inner, "strict", False)

    def rerank(self, *args, **kwargs) -> list[tuple[int, float]]:
        import math

        return [(i, 1 / (1 + math.exp(-s))) for i, s in self.inner.rerank(*args, **kwargs)]


class LengthReranker(Reranker):
    """Scores by the characters of a document, modulo a number: offline, with many ties (this project's addition)."""

    model = "length"

    def __init__(self, modulus: int = 97, strict: bool = False):
        self.modulus, self.strict = modulus, strict

    def rerank(self, query: str, documents: list[str], top_n: int = 0, instruction: str = "", max_document_bytes: int = 0) -> list[tuple[int, float]]:
        found = sorted(((i, float(len(d) % self.modulus)) for i, d in enumerate(documents)), key=lambda x: -x[1])
        return found[:top_n] if top_n > 0 else found


def new_reranker(c: RerankConfig) -> Reranker:
    for name, value in (("Backend", c.backend), ("BaseURL", c.base_url), ("Model", c.model)):
        if not value:
            raise ValueError(f"rerank: {name} is required")
    if c.backend == TEI:
        raise ValueError("rerank: backend 'tei' is not yet implemented")
    if c.backend != JINA:
        raise ValueError(f"rerank: unknown backend {c.backend!r}")
    r = JinaReranker(c.base_url, c.model, c.api_key, c.strict, c.timeouts)
    return Normalizing(r) if c.normalize_scores else r


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rank(scored: DataFrame, top_n: int = 0, query: str = "query_id", score: str = "score", order: tuple[str, ...] = ("doc_index",)) -> DataFrame:
    """Adds rank within each query, best first, ties by ``order``; only the top_n of each where given.

    A filter on the rank lets each task drop its own losers before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), *order)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_n) if top_n > 0 else out


def rerank_df(candidates: DataFrame, reranker: Reranker, top_n: int = 0, instruction: str = "", max_document_bytes: int = 0, registry: Registry = DEFAULT) -> DataFrame:
    """query_id, doc_index, score, available, error, rank from (query_id, query, doc_index, document).

    A query's shortlist is dealt in requests of MOST documents by their place in it, so no task
    sends a whole query; the byte budget (max_document_bytes, else the model's registered one)
    is fixed when the plan is made. Documents over it are cut, or, if the reranker is strict,
    fail their query. Any request that fails fails its whole query: score is null for all of it,
    available false if the backend was away and else error says why, and the first-stage order
    stands. Documents that the backend leaves out of its answer are left out here, too. Equal
    scores keep the order of requests and answers. A null document isn't sent: it has no score
    and an error of its own, and ranks last. Normalized scores are made of the ranked raw ones,
    so documents whose scores round to one number keep their order."""
    normalized = isinstance(reranker, Normalizing)
    while isinstance(reranker, Normalizing):
        reranker = reranker.inner
    q, d = candidates.schema["query_id"].dataType.simpleString(), candidates.schema["doc_index"].dataType.simpleString()
    most = max_document_bytes if max_document_bytes > 0 else registry.lookup_limits(reranker.model).max_bytes
    by_query = Window.partitionBy("query_id")
    own = candidates.select("query_id", "query", "doc_index", "document")
    sent = own.where("document IS NOT NULL")
    size = F.octet_length("document")
    over = F.lit(False) if most <= 0 or not getattr(reranker, "strict", False) else size > most
    why = F.concat(F.lit("rerank: document "), F.col("doc_index").cast("string"), F.lit(f" exceeds {reranker.model} MaxBytes ("), size.cast("string"), F.lit(f" > {most})"))
    sent = sent.withColumn("refused", F.min(F.when(over, why)).over(by_query)).withColumn("document", limit_documents(F.col("document"), most))
    sent = sent.withColumn("request", F.floor((F.row_number().over(by_query.orderBy("doc_index")) - 1) / MOST))

    def request(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_index")
        out = group[["query_id", "doc_index"]].assign(score=float("nan"), place=-1, request=int(group["request"].iloc[0]), available=True, error=group["refused"])
        if group["refused"].notna().any():
            return out
        try:
            got = reranker.rerank(group["query"].iloc[0], group["document"].tolist(), 0, instruction, most if most > 0 else NO_BUDGET)
        except (RerankUnavailable, TimeoutError):
            return out.assign(available=False)
        except Exception as e:
            return out.assign(error=str(e))
        scores, places = [float("nan")] * len(group), [-1] * len(group)
        for place, (i, s) in enumerate(got):
            scores[i], places[i] = s, place
        return out.assign(score=scores, place=places)

    scored = sent.groupBy("query_id", "request").applyInPandas(request, f"query_id {q}, doc_index {d}, score double, place int, request bigint, available boolean, error string")
    scored = scored.withColumn("available", F.min("available").over(by_query)).withColumn("error", F.min("error").over(by_query))
    good = F.col("available") & F.col("error").isNull()
    scored = scored.where(~good | (F.col("place") >= 0)).withColumn("score", F.when(good, F.col("score")))
    missing = own.where("document IS NULL").select("query_id", "doc_index", F.lit(None).cast("double").alias("score"), F.lit(MOST).alias("place"), F.lit(None).cast("bigint").alias("request"), F.lit(True).alias("available"), F.lit("rerank: no document").alias("error"))
    w = by_query.orderBy(F.desc_nulls_last("score"), F.when(F.col("score").isNotNull(), F.col("request")).asc_nulls_last(), F.when(F.col("score").isNotNull(), F.col("place")).asc_nulls_last(), F.col("request").isNull(), "doc_index")
    ranked = scored.unionByName(missing).withColumn("rank", F.row_number().over(w))
    out = (ranked.withColumn("score", sigmoid(F.col("score"))) if normalized else ranked).select("query_id", "doc_index", "score", "available", "error", "rank")
    return out.where(F.col("rank") <= top_n) if top_n > 0 else out
