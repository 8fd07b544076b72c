"""Registered queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomtext.functions import errors, models, prompts, text, usage, vectors
from fathomtext.functions.models import Limits
from fathomtext.operators import budget, cache, embed, markdown, pairs, rerank, split, tokens
from fathomtext.operators.split import SplitOptions
from fathomtext.sources.config import config_from_env
from fathomtext.sources.embedders import HashEmbedder, SizeEmbedder, embed_one

SERVED = ["nomic-embed-text", "user.Nomic-Embed-Text-GGUF:latest", "nomic-embed-text-v2", "Embeddinggemma.gguf", "bge-reranker-v2-m3:q8", "nomic-embed-text-v2-moe", "unknown-model", ":odd"]
ALIASES = " User.Odd = x , :ODD=embeddinggemma,, Nomic-Embed-Text-v2-moe=nomic-embed-text-v2"
SETTINGS = [("a", "b", "10", "20", "30s", ""), ("", "b", "", "20", "", "1m30s"), ("", "", "", "", "", ""), ("a", "", "x", "5", "none", "5s"), ("", "b", "-1", "", "", ""), ("a", "b", "0", "7", "", ""), ("", "", "+8", "", "1h2m", ""), ("", "", "", "", "12", ""), ("", "", "1.5", "", "", ""), ("", "", "", "", "-5s", "")]
ANSWERS = [(400, "maximum context reached"), (400, "invalid token"), (413, ""), (429, "slow down"), (500, "too long"), (503, ""), (404, "no such model"), (422, "Input LENGTH over"), (301, "")]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _names(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in SERVED))).alias("name"))


def _answers(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(s).alias("status"), F.lit(b).alias("body")) for s, b in ANSWERS))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stripped, split, embedded offline, and the nearest chunks to one query."""
    e = HashEmbedder()
    pages = _t(spark, sf_dir, "pages").select("page_id", text.strip_nonsemantic(F.col("html")).alias("text"))
    chunks = split.split_df(pages, options=SplitOptions(max_bytes=1024, overlap=128), keep=("page_id",))
    chunks = chunks.withColumn("row_id", F.concat_ws(":", "page_id", "ordinal"))
    found = embed.embed_df(chunks, e)
    query = F.array(*(F.lit(float(x)).cast("float") for x in embed_one(e, "the report of the year")))
    scored = found.select("row_id", F.round(vectors.cosine(F.col("vector"), query), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "row_id").limit(5)


def strip_nonsemantic(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    extra = F.concat(F.col("html"), F.lit("\n\n\n\n![pic](http://a.b/c) [home]("), F.col("url"), F.lit(") é"), F.col("url"), F.lit(" end  "))
    return p.select("page_id", text.strip_nonsemantic(extra).alias("text"))


def normalize_query(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.normalize_query(F.concat(F.lit("  "), F.col("text"), F.lit("\n ÉÀ \tX"))).alias("query"))


def cache_key(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.sha2(text.cache_key(F.lit("nomic-embed-text"), F.lit(64), F.col("text")), 256).alias("key"))


def truncate_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.truncate_bytes(F.col("text"), 1021).alias("text"))


def limits_flag(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.octet_length("text") > 6000).alias("over"), F.sum(F.octet_length(text.truncate_bytes(F.col("text"), 6000))).alias("bytes"))


def strict_reject(spark, sf_dir):
    r = budget.apply_limits(F.col("text"), Limits(6000, 0), "m", strict=True, index=F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", F.octet_length("r.text").alias("bytes"), F.col("r.error.message").alias("message"), F.col("r.error.permanent").alias("permanent"))


def limit_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.octet_length(budget.limit_documents(F.col("text"), 18000)).alias("bytes"))


def shrink_once(spark, sf_dir):
    size = F.octet_length("text")
    return _docs(spark, sf_dir).select("doc_id", F.when(size > 256, text.shrink_size(F.col("text"))).otherwise(size).alias("keep_bytes"), (size > 256).alias("changed"))


def format_record(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", prompts.format_record(prompts.fields(("lang", F.col("lang")), ("empty", F.lit("")), ("source", F.col("source"))), F.col("text")).alias("record"))


def format_for_task(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", *(prompts.format_for_task(m, t, F.col("source")).alias(f"{m[:5]}_{t.replace('-', '_')}") for m in ("nomic-embed-text", "embeddinggemma") for t in (prompts.RETRIEVAL_QUERY, prompts.RETRIEVAL_DOCUMENT, prompts.CODE_RETRIEVAL)))


def format_record_for_task(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", prompts.format_record_for_task("nomic-embed-text", prompts.CLUSTERING, prompts.fields(("lang", F.col("lang"))), F.col("text")).alias("record"))


def format_retrieval_doc(spark, sf_dir):
    d = _docs(spark, sf_dir)
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    items = prompts.fields(("lang", F.col("lang")))
    return d.select("doc_id", prompts.format_retrieval_document("embeddinggemma", title, items, F.col("source")).alias("gemma"), prompts.format_retrieval_document("nomic-embed-text", title, items, F.col("source")).alias("nomic"))


def canonical_model(spark, sf_dir):
    return _names(spark).select("name", models.canonical_name(F.col("name")).alias("canonical"))


def lookup_limits(spark, sf_dir):
    x = _names(spark).select("name", models.model_limits(F.col("name")).alias("l"))
    return x.select("name", "l.max_bytes", "l.max_tokens")


def lookup_model(spark, sf_dir):
    rows = [(n, i.canonical, i.limits.max_bytes, i.has_prompts, known) for n in SERVED for i, known in [models.DEFAULT.lookup_model(n)]]
    return spark.createDataFrame(rows, "name string, canonical string, max_bytes int, has_prompts boolean, known boolean")


def alias_models(spark, sf_dir):
    """Names with aliases: those of before a reset are gone, those of a parsed list hold; exact names keep their own budgets."""
    r = models.Registry()
    r.register_alias("unknown-model", "embeddinggemma")
    r.reset_aliases()
    for served, canonical in models.parse_aliases("ALIASES", ALIASES):
        r.register_alias(served, canonical)
    x = _names(spark).select("name", models.canonical_name(F.col("name"), r).alias("canonical"), models.model_limits(F.col("name"), r).alias("l"))
    return x.select("name", "canonical", "l.max_bytes", "l.max_tokens")


def registered_limits(spark, sf_dir):
    r = models.Registry()
    r.register_limits("unknown-model", Limits(700, 0))
    r.register_limits("nomic-embed-text", Limits(0, 512))
    r.unregister_limits("embeddinggemma")
    return _names(spark).select("name", models.model_limits(F.col("name"), r).alias("l")).select("name", "l.max_bytes", "l.max_tokens")


def strict_model(spark, sf_dir):
    return _names(spark).select("name", models.strict_error(F.col("name")).alias("error"))


def own_prompters(spark, sf_dir):
    """Prompters registered for a model of one's own, one taken away again."""
    r = models.Registry()
    prompts.register_task_prompter("mine", lambda task, t: F.concat(F.lit(f"[{task}] "), t), r)
    prompts.register_document_prompter("mine", lambda title, t: F.concat(F.lit("<"), F.coalesce(title, F.lit("")), F.lit("> "), t), r)
    prompts.register_task_prompter("gone", prompts.lookup_task_prompter("mine", r), r)
    prompts.register_task_prompter("gone", None, r)
    d = _docs(spark, sf_dir)
    items = prompts.fields(("lang", F.col("lang")))
    return d.select("doc_id", prompts.format_for_task("user.Mine:latest", prompts.CLUSTERING, F.col("source"), r).alias("mine"), prompts.format_for_task("gone", prompts.CLUSTERING, F.col("source"), r).alias("gone"), prompts.format_retrieval_document("mine", F.col("lang"), items, F.col("source"), r).alias("document"))


def effective_limits(spark, sf_dir):
    cases = [("nomic-embed-text", 0, 0, 0.0), ("nomic-embed-text", 100, 0, 0.0), ("x", 0, 1000, 1.75), ("x", 0, 1000, 0.0), ("x", 50, 1000, 1.75)]
    rows = [(m, b, t, r, e.max_bytes, e.max_tokens) for m, b, t, r in cases for e in [models.DEFAULT.effective_limits(m, Limits(b, t), r)]]
    return spark.createDataFrame(rows, "model string, set_bytes int, set_tokens int, ratio double, max_bytes int, max_tokens int")


def classify_http(spark, sf_dir):
    return _answers(spark).select("status", "body", errors.classify_http(F.col("status"), F.col("body")).alias("c")).select("status", "body", "c.permanent", "c.too_long")


def rerank_classify(spark, sf_dir):
    return _answers(spark).select("status", "body", errors.classify_rerank_http(F.col("status"), F.col("body")).alias("c")).select("status", "body", "c.unavailable", "c.permanent", "c.too_long")


def context_length(spark, sf_dir):
    return _answers(spark).select("status", "body", errors.context_length(F.col("status"), F.col("body")).alias("context_length"))


def _pairs(spark, sf_dir, most=0):
    """Every vector whose id is divisible by 100 is a query against all others, in blocks."""
    return pairs.all_pairs(_t(spark, sf_dir, "embeddings"), most=most, queries="id % 100 = 0")


def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def cosine_topk(spark, sf_dir):
    return rerank.rank(_pairs(spark, sf_dir, 10), 10)


def cosine_guards(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    return e.select("vec_id", vectors.cosine(F.col("embedding"), zero).alias("zero"), vectors.cosine(F.col("embedding"), F.slice("embedding", 1, 3)).alias("uneven"), vectors.cosine(F.slice("embedding", 1, 0), F.slice("embedding", 1, 0)).alias("empty"))


def codec_roundtrip(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").withColumn("b", vectors.encode_floats(F.col("embedding")))
    return e.select("vec_id", F.octet_length("b").alias("bytes"), (vectors.decode_floats(F.col("b")) == F.col("embedding")).alias("same"), F.round(F.aggregate(vectors.decode_floats(F.col("b")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(vectors.decode_floats(F.substring("b", 1, 9))).alias("cut"))


def fingerprint_check(spark, sf_dir):
    return vectors.fingerprint(_t(spark, sf_dir, "embeddings"), "nomic-embed-text", "embedding")


def _log(spark, sf_dir):
    d = _docs(spark, sf_dir)
    words = F.size(F.split("text", " "))
    return d.select(F.col("doc_id").alias("seq"), F.col("lang").alias("model"), F.octet_length("text").cast("bigint").alias("bytes"), words.cast("bigint").alias("tokens"), (words >= 500).alias("clipped"))


def fingerprint_compare(spark, sf_dir):
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", vectors.fingerprint_error(cut, "m", ("m", 3)).alias("error"))


def usage_rows(spark, sf_dir):
    d = _log(spark, sf_dir)
    u = usage.usage_row(F.col("model"), F.lit(1), F.col("bytes"), F.col("tokens"), Limits(0, 500))
    return d.select("seq", u.alias("u")).select("seq", "u.model", "u.inputs", "u.bytes", "u.tokens", "u.max_tokens", "u.clipped")


def _calibrated(df):
    return df.select("model", "samples", "clipped", *(F.round(c, 6).alias(c) for c in ("min", "p10", "median", "mean")))


def calibration(spark, sf_dir):
    return _calibrated(usage.calibration(_log(spark, sf_dir)))


def calibration_window(spark, sf_dir):
    return _calibrated(usage.calibration(_log(spark, sf_dir), 50))


def sigmoid_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("query_id", "doc_index", F.round(rerank.sigmoid(F.col("score") * 10), 6).alias("score"))


def rerank_topn(spark, sf_dir):
    return rerank.rank(_pairs(spark, sf_dir, 3), 3)


def rerank_ties(spark, sf_dir):
    return pairs.ranked_pairs(_t(spark, sf_dir, "embeddings"), queries="id % 100 = 0", digits=1)


def rerank_lengths(spark, sf_dir):
    """Each source's documents in first-stage order, reranked in requests of 256 by an offline reranker with ties."""
    d = _docs(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("query_id"), F.lit("q").alias("query"), F.col("doc_id").alias("doc_index"), F.col("text").alias("document"))
    return rerank.rerank_df(d, rerank.LengthReranker())


def rerank_normalized(spark, sf_dir):
    """As rerank_lengths, with normalized scores; many of them round to 1."""
    d = _docs(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("query_id"), F.lit("q").alias("query"), F.col("doc_id").alias("doc_index"), F.col("text").alias("document"))
    return rerank.rerank_df(d, rerank.Normalizing(rerank.LengthReranker())).withColumn("score", F.round("score", 9))


def cache_split(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("role = 'user'")
    stored = cache.keyed(c.where("conv_id % 3 = 0"), "m", 64).groupBy("key").agg(F.lit(None).cast("array<float>").alias("vector"))
    hits, misses = cache.split_cached(c, stored, "m", 64)
    return hits.select("conv_id", "turn", F.lit(True).alias("hit")).unionByName(misses.select("conv_id", "turn", F.lit(False).alias("hit")))


def cache_evict(spark, sf_dir):
    c = cache.keyed(_t(spark, sf_dir, "conversations").where("role = 'user'"), "m", 64).select(F.sha2("key", 256).alias("key"), F.lit(None).cast("array<float>").alias("vector"), F.col("conv_id").alias("last_used"))
    return cache.evict(c, 20).select("key", "last_used")


def token_truncate_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.rtrim(tokens.truncate_tokens(F.col("text"), 10)).alias("text"))


def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens.count_tokens(F.col("text")).alias("n"))


def _spans(df, **options):
    return split.split_df(df, options=SplitOptions(**options), keep=("doc_id",))


def _offsets(df):
    return df.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("start").alias("cs"), F.col("end").alias("ce"))


def split_bytes(spark, sf_dir):
    return _offsets(_spans(_docs(spark, sf_dir), max_bytes=1024))


def split_overlap(spark, sf_dir):
    return _offsets(_spans(_docs(spark, sf_dir), max_bytes=1024, overlap=128))


def split_full(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), max_bytes=1024, overlap=128).drop("headings")


def split_sql(spark, sf_dir):
    split.register_sql(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("__documents")
    return spark.sql("SELECT d.doc_id, s.text, s.start, s.end, s.ordinal FROM __documents d, LATERAL split_text(d.text, 2000, 0) s")


def _rendered(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    line = F.concat(F.lit("\n## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    turns = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("t"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("t")).alias("text"))


def split_markdown(spark, sf_dir):
    return _spans(_rendered(spark, sf_dir), max_bytes=400, markdown=True).withColumn("headings", F.array_join("headings", " > "))


def split_minbytes(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), max_bytes=1000, min_bytes=300).drop("headings")


def split_tokens(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), max_tokens=100, tokenizer=tokens.count_words).drop("headings")


def headings(spark, sf_dir):
    return _rendered(spark, sf_dir).select("doc_id", F.inline(markdown.headings(F.col("text")))).withColumn("path", F.array_join("path", " > "))


def embed_hash(spark, sf_dir):
    return embed.embed_df(_docs(spark, sf_dir), HashEmbedder(), "doc_id").select("doc_id", F.posexplode("vector").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def embed_shrinking(spark, sf_dir):
    """Texts beyond the backend's window are cut until it takes them; the vector is the size that was sent."""
    return embed.embed_df(_docs(spark, sf_dir), SizeEmbedder(1000), "doc_id", size=1).select("doc_id", F.col("vector")[0].cast("int").alias("bytes"), F.col("error.message").alias("error"))


def settings(spark, sf_dir):
    """Model, byte budget and time limit from the environment: one's own variables before the canonical ones."""

    def row(case):
        names = [p + s for s in ("_MODEL", "_MAX_BYTES", "_TIMEOUT") for p in ("APP", "EMBEDDING")]
        try:
            c = config_from_env("APP", dict(zip(names, case, strict=True)))
        except ValueError:
            return (*case, None, None, None, False)
        return (*case, c.model, c.max_bytes, float(c.timeouts.base), True)

    return spark.createDataFrame([row(c) for c in SETTINGS], "own_model string, model string, own_bytes string, bytes string, own_timeout string, timeout string, found_model string, found_bytes int, found_timeout double, good boolean")


def batch_embed_results(spark, sf_dir):
    out = embed.embed_df(_docs(spark, sf_dir), HashEmbedder(), "doc_id", deterministic=True)
    return out.select("doc_id", F.size("vector").alias("dim"), F.col("error").isNull().alias("good"))


def cached_embedding(spark, sf_dir):
    e = HashEmbedder()
    c = _t(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), "text")
    known = embed.embed_df(c.where("row_id LIKE '1%'"), e).join(c, "row_id")
    stored = cache.keyed(known, e.model, e.dim).groupBy("key").agg(F.max_by("vector", "row_id").alias("vector"))
    out, _ = cache.embed_cached(c, stored, e, e.dim, 1)
    return out.select("row_id", "cached", F.posexplode("vector").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


_ALL = [strip_nonsemantic, normalize_query, cache_key, truncate_bytes, limits_flag, strict_reject, limit_documents, shrink_once, format_record, format_for_task, format_record_for_task, format_retrieval_doc, canonical_model, lookup_limits, alias_models, registered_limits, strict_model, own_prompters, settings, lookup_model, effective_limits, classify_http, rerank_classify, context_length, cosine_pairs, cosine_topk, cosine_guards, codec_roundtrip, fingerprint_check, fingerprint_compare, usage_rows, calibration, calibration_window, sigmoid_scores, rerank_topn, rerank_ties, rerank_lengths, rerank_normalized, cache_split, cache_evict, token_truncate_words, token_count, split_bytes, split_overlap, split_full, split_sql, split_markdown, split_minbytes, split_tokens, headings, embed_hash, embed_shrinking, batch_embed_results, cached_embedding]


def queries():
    return {f.__name__: f for f in _ALL} | {"flagship": flagship}


def oracle_sql():
    from fathomtext.plans.oracle import ORACLE

    return ORACLE
