"""Kernels: split invariants, headings, tokens, shrinking, batches, configuration, classification, stub servers."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from fathomtext.functions import errors, models
from fathomtext.functions.models import Limits
from fathomtext.operators import cache, embed, markdown, rerank, tokens
from fathomtext.operators.split import SplitOptions, split
from fathomtext.sources import config, embedders
from fathomtext.sources.http import Timeouts


def check(text, o, budget):
    raw, last = text.encode(), -1
    for i, c in enumerate(split(text, "", o)):
        assert c.ordinal == i and c.start > last and raw[c.start : c.end] == c.text.encode()
        assert c.end - c.start <= budget
        last = c.start


def test_split_invariants():
    r = random.Random(5)
    parts = ["word ", "é", "日本", "\n", "\n\n", "end. ", "# H\n", "```\n", "x" * 30, "🙂", "\t"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 80)))
        for o in (SplitOptions(max_bytes=40), SplitOptions(max_bytes=64, overlap=20, markdown=True), SplitOptions(max_bytes=50, min_bytes=20)):
            check(text, o, o.max_bytes)
        bare = "".join(c.text for c in split(text, "", SplitOptions(max_bytes=40)))
        assert "".join(bare.split()) == "".join(text.split())


def test_split_cases():
    assert len(split("A" * 1000, "", SplitOptions(max_bytes=100))) == 10
    assert split(" \n\t", "", SplitOptions(max_bytes=10)) == []
    assert len(split("long " * 9000)) == 1
    a = "# A\n" + "a" * 192 + "\n\n# B\n" + "b" * 196
    spans = [(c.start, c.end) for c in split(a, "", SplitOptions(max_bytes=220, overlap=40, markdown=True))]
    assert any(x[0] > spans[0][0] and x[1] <= spans[0][1] for x in spans[1:])  # the small repeat before a section
    assert len(split(a, "", SplitOptions(max_bytes=220, overlap=40, markdown=True, dedupe_overlap=True))) < len(spans)
    for c in split("one two three " * 30, "", SplitOptions(max_tokens=7, tokenizer=tokens.count_words)):
        assert tokens.count_words(c.text) <= 7


@pytest.mark.parametrize("line, want", [("# A", (1, "A")), ("###### F", (6, "F")), ("####### G", None), ("#tag", None), ("    # code", None), ("## C#", (2, "C")), ("##", None), ("Title\n===", (1, "Title")), ("Sub\n-", (2, "Sub")), ("```\n# no\n```", None), ("\f\n===", None), ("# \u3000", None), ("#\u00a0x", None), ("# \u00a0Title\u2003##", (1, "Title")), ("\t```\n# seen", (1, "seen")), ("   ~~~\n# no", None)])
def test_headings(line, want):
    found = markdown.scan(line.encode())
    assert [(h.level, h.title) for h in found] == ([want] if want else [])


def test_heading_paths():
    found = markdown.scan(b"# A\n## B\n# C\n### D\n")
    assert [list(h.path) for h in found] == [["A"], ["A", "B"], ["C"], ["C", "D"]]
    assert markdown.path_at(found, 5) == ["A", "B"] and markdown.path_at(found[1:], 0) is None


def test_tokens():
    assert tokens.truncate(tokens.count_words, b"word " * 50, 10).split() == [b"word"] * 10
    assert tokens.truncate(len, "ééééé".encode(), 1) == b""
    assert tokens.truncate(len, "日本語テキスト".encode(), 2) == "日".encode()


def test_truncation_is_bisection():
    """The same prefix as bisection with a count at every step, and work in proportion to the prefix."""

    def plain(count, text, most):
        if most <= 0 or count(text.decode("utf-8", "replace")) <= most:
            return text
        low, high = 0, len(text)
        while low < high:
            mid = tokens.back_up(text, (low + high + 1) // 2)
            if mid <= low:
                break
            if count(text[:mid].decode("utf-8", "replace")) <= most:
                low = mid
            else:
                high = tokens.back_up(text, mid - 1)
        return text[:low]

    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(["a", "é", "日本", " ", "🙂", "word "]) for _ in range(r.randint(0, 300))).encode()
        for count in (tokens.count_words, len):
            for most in (1, 3, 40):
                assert tokens.truncate(count, text, most) == plain(count, text, most)
    seen = []
    tokens.truncate(lambda t: seen.append(len(t)) or tokens.count_words(t), b"word " * 200_000, 10)
    assert sum(seen) < 20_000


def test_shrink_and_batches():
    assert [len(x) for x in embedders.shrink(["x" * 1000, "x" * 266, "x" * 256])[0]] == [800, 256, 256]

    class Odd(embedders.Embedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise errors.PermanentError("poisoned")
            return [[1.0] for _ in texts]

    got = embed.batch_results(Odd(), ["a", "bad", "c"], 2)
    assert [v for v, _ in got] == [[1.0], None, [1.0]]
    assert got[1][1]["permanent"] and got[1][1]["index"] == 1 and got[1][1]["batch_cause"] == "poisoned"
    with pytest.raises(RuntimeError):
        embed.batch_results(Odd(), ["bad"])
    assert embed.batch_results(Odd(), []) == []


def test_registry():
    r = models.Registry()
    r.register_alias(" Served ", "nomic-embed-text ")
    assert r.canonical("sERVED") == "nomic-embed-text" and r.lookup_limits("served").max_bytes == 6000
    r.register_alias("bge-reranker-v2-m3", "x")
    assert r.lookup_limits("bge-reranker-v2-m3").max_bytes == 18000  # the exact entry wins
    assert r.effective_limits("x", Limits(0, 1000), 1.75) == Limits(1750, 1000)
    assert r.canonical("\u2003\tNomic-Embed-Text\n") == "nomic-embed-text" and r.canonical("\x1cm") == "\x1cm"
    with pytest.raises(ValueError):
        r.check_strict("nobody")
    with pytest.raises(ValueError):
        models.parse_aliases("VAR", "a=b,c")


def test_config():
    env = {"X_MODEL": "m", "EMBEDDING_BASE_URL": "http://h", "X_TIMEOUT": "1m30s", "EMBEDDING_PER_INPUT_TIMEOUT": "none", "X_STRICT_MODEL": "yes"}
    c = config.config_from_env("X", env, models.Registry())
    assert (c.model, c.base_url, c.timeouts.base, c.timeouts.per_input, c.strict_model) == ("m", "http://h", 90.0, -1.0, False)
    for bad in ({"EMBEDDING_MAX_BYTES": "0"}, {"EMBEDDING_TIMEOUT": "5"}, {"EMBEDDING_STRICT": "yes"}, {"EMBEDDING_TIMEOUT": "-5s"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            config.config_from_env(env=bad)
    assert Timeouts().budget(25) == 80 and Timeouts(-1).budget(3) is None and Timeouts(5, -1).budget(9) == 5
    with pytest.raises(ValueError, match="not yet implemented"):
        rerank.new_reranker(config.RerankConfig("tei", "u", "m"))


def test_errors():
    assert errors.http_error("", 429, "").too_long is False and not errors.is_retryable(errors.http_error("", 429, ""))
    assert not errors.is_rerank_available(errors.rerank_http_error("", 503, "")) and errors.is_rerank_available(errors.rerank_http_error("", 400, ""))


@pytest.fixture
def server():
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            status, answer = 200, {}
            if self.path == "/api/embed":
                if any(len(t) > 600 for t in body["input"]):
                    status, answer = 400, {"error": "input length exceeds the context length"}
                else:
                    answer = {"embeddings": [[float(len(t))] for t in body["input"]], "prompt_eval_count": 9}
            elif self.path == "/v1/embeddings":
                answer = {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))], "usage": {"prompt_tokens": 3}}
            elif self.path == "/v1/rerank":
                answer = {"results": [{"index": i, "relevance_score": float(d)} for i, d in enumerate(body["documents"])]}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", seen
    s.shutdown()


def test_wire(server):
    url, seen = server
    o = embedders.OllamaEmbedder(url, "m", Limits(0, 100))
    assert o.embed(["x" * 1000, "y"]) == [[512.0], [1.0]] and o.usage[0]["tokens"] == 9 and o.fingerprint == ("m", 1)
    assert embedders.OpenAIEmbedder(url, "m").embed(["a", "b", "c"]) == [[0.0], [1.0], [2.0]]
    j = rerank.JinaReranker(url, "m")
    assert [i for i, _ in j.rerank("q", ["3", "1", "9", "5"])] == [2, 3, 0, 1] and j.rerank("q", ["3", "1", "9", "5"], 1) == [(2, 9.0)]
    assert len(j.rerank("q", [str(i) for i in range(519)], instruction="do")) == 519 and seen[-1]["query"] == "do\nq" and "top_n" not in seen[-1]
    c = cache.QueryCache(2)
    c.single(o, "A  b")
    n = len(seen)
    assert c.single(o, "a b") and len(seen) == n and len(c) == 1


def test_rerank_df(spark, server):
    url, _ = server
    rows = [(1, "q", i, str((i * 7) % 10)) for i in range(6)] + [(2, "q", 0, "4")]
    df = spark.createDataFrame(rows, "query_id int, query string, doc_index int, document string")
    got = rerank.rerank_df(df, rerank.JinaReranker(url, "m"), top_n=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_index) for r in got] == [(1, 4), (1, 1), (2, 0)]
    away = rerank.rerank_df(df, rerank.JinaReranker("http://127.0.0.1:9", "m")).where("query_id = 1").orderBy("rank").collect()
    assert [r.doc_index for r in away] == list(range(6)) and not away[0].available and away[0].score is None


class Scripted(rerank.Reranker):
    """Scores are the documents' numbers, answered from the last to the first; "away", "bad" and "skip" do what they say."""

    model = "nomic-embed-text"

    def __init__(self, strict=False):
        self.strict = strict

    def rerank(self, query, documents, top_n=0, instruction="", max_document_bytes=0):
        assert len(documents) <= rerank.MOST
        if "away" in documents:
            raise errors.RerankUnavailable("503")
        if "bad" in documents:
            raise errors.PermanentError("400")
        found = [(i, float(d.split()[0])) for i, d in enumerate(documents) if d != "skip"]
        return sorted(found[::-1], key=lambda x: -x[1])


def test_rerank_df_cases(spark):
    rows = [(1, "q", i * 1000, str(i % 5)) for i in range(600)]  # sparse places, 3 requests, ties
    rows += [(2, "q", 0, "1"), (2, "q", 1, None), (2, "q", 2, "skip"), (2, "q", 3, "7")]
    rows += [(3, "q", i, "away" if i == 299 else str(i)) for i in range(300)]
    rows += [(4, "q", 0, "3"), (4, "q", 1, "bad")]
    rows += [(5, "q", 0, "5 " + "é" * 4000), (5, "q", 1, "6")]
    df = spark.createDataFrame(rows, "query_id int, query string, doc_index int, document string")

    def run(strict):
        out = {}
        for r in rerank.rerank_df(df, Scripted(strict)).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r)
        return out

    got = run(False)
    want = sorted(range(600), key=lambda i: (-(i % 5), i // 256, -i))  # requests, then the order of their answers
    assert [r.doc_index // 1000 for r in got[1]] == want and [r["rank"] for r in got[1]] == list(range(1, 601))
    assert [(r.doc_index, r.score, r.error) for r in got[2]] == [(3, 7.0, None), (0, 1.0, None), (1, None, "rerank: no document")]
    assert [r.doc_index for r in got[3]] == list(range(300)) and all(r.score is None and not r.available for r in got[3])  # not a mix
    assert [(r.doc_index, r.score, r.available, r.error) for r in got[4]] == [(0, None, True, "400"), (1, None, True, "400")]
    assert [(r.doc_index, r.score) for r in got[5]] == [(1, 6.0), (0, 5.0)]
    strict = run(True)
    assert [(r.doc_index, r.score) for r in strict[5]] == [(0, None), (1, None)] and strict[5][0].error == "rerank: document 0 exceeds nomic-embed-text MaxBytes (8002 > 6000)"
    own = models.Registry()
    own.register_limits("nomic-embed-text", Limits(9000, 0))
    fine = rerank.rerank_df(df.where("query_id = 5"), Scripted(True), registry=own).collect()  # the registry of the plan
    assert {r.error for r in fine} == {None}
    assert rerank.rerank_df(df.limit(0), Scripted()).count() == 0


class Counted(embedders.Embedder):
    """Writes a file for each call, as calls are made in other processes."""

    def __init__(self, folder):
        self.model, self.dim, self.folder, self.told = "counted", 2, folder, []

    def embed(self, texts):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps(texts))
        if any("bad" in t for t in texts):
            raise errors.PermanentError("poisoned")
        self.told += [{"model": self.model, "inputs": len(texts), "bytes": sum(map(len, texts)), "tokens": len(texts), "max_tokens": 0, "clipped": False}]
        return [[float(len(t)), 1.0] for t in texts]

    def take_usage(self):
        out, self.told = self.told, []
        return out


def test_misses_are_embedded_once(spark, tmp_path):
    import os

    e = Counted(str(tmp_path))
    q = spark.createDataFrame([(1, "Hello"), (2, "hello "), (3, "other"), (4, None), (5, "known"), (5, "known")], "row_id int, text string")
    stored = cache.keyed(spark.createDataFrame([("KNOWN", [9.0, 9.0])], "text string, vector array<float>"), "counted", 2).select("key", "vector")
    out, append = cache.embed_cached(q, stored, e, 2, 7)
    first = [(r.row_id, r.vector, r.cached) for r in out.collect()]
    rows = append.collect()
    out.collect(), append.collect()
    sent = sorted(t for f in os.listdir(tmp_path) for t in json.loads((tmp_path / f).read_text()))
    assert sent == ["Hello", "hello ", "other"]  # however often the results are read
    assert sorted(first) == [(1, [5.0, 1.0], False), (2, [6.0, 1.0], False), (3, [5.0, 1.0], False), (4, None, False), (5, [9.0, 9.0], True), (5, [9.0, 9.0], True)]
    assert {r.key: r.vector for r in rows} == {"counted\0002\0hello": [6.0, 1.0], "counted\0002\0other": [5.0, 1.0]} and all(r.last_used == 7 for r in rows)
    nulls = spark.createDataFrame([(None,), (None,)], "text string")
    assert [r.key for r in cache.keyed(nulls, "m", 2).collect()] == [None, None] and cache.split_cached(nulls, cache.keyed(nulls, "m", 2).selectExpr("key", "array(1f) AS vector"), "m", 2)[0].count() == 0


def test_usage_of_a_run(spark, tmp_path):
    from fathomtext.functions.usage import calibration

    df = spark.createDataFrame([(i, None if i == 3 else "bad" if i == 7 else "x" * i) for i in range(1, 11)], "row_id bigint, text string").coalesce(1)
    from fathomtext.sources.tables import keep

    done = keep(embed.embed_df(df, Counted(str(tmp_path)), size=5), "done")
    log = embed.usage_log(done).orderBy("seq").collect()
    assert [(r.seq, r.inputs) for r in log] == [(1, 4), (6, 1), (8, 1), (9, 1), (10, 1)]  # a whole batch, then one by one
    (c,) = calibration(embed.usage_log(done)).collect()
    assert (c.model, c.samples, c["min"]) == ("counted", 5, 3.0)
    assert tuple(embed.progress(done).first()) == (8, 1, 10, 8)
    assert embed.embed_all(Counted(str(tmp_path)), ["a", "bb", "ccc"], 2) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]
    with pytest.raises(errors.PermanentError):
        embed.embed_all(Counted(str(tmp_path)), ["a", "bad"], 1)


def test_factory_takes_tokenizer_and_hook(server):
    url, seen = server
    told = []
    e = embedders.new_embedder(config.Config("ollama", url, "m", max_tokens=3, tokenizer=tokens.count_words, on_usage=told.append))
    e.embed(["one two three four", "five"])
    assert seen[-1]["input"][0].split() == ["one", "two", "three"] and told[0]["tokens"] == 9 and len(e.take_usage()) == 1 and e.take_usage() == []


def test_calibration_stream_of_bad_rows(spark, tmp_path):
    from fathomtext.streaming.streams import calibration_stream

    schema = "seq bigint, model string, bytes bigint, tokens bigint, clipped boolean"
    spark.createDataFrame([(1, "none", 5, 0, False), (2, "some", 4, 2, False)], schema).write.parquet(str(tmp_path / "in"))
    q = calibration_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bad_rows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.model, r.samples) for r in spark.table("bad_rows").collect()] == [("some", 1)]


def test_calibration_stream(spark, tmp_path):
    from fathomtext.streaming.streams import calibration_stream

    schema = "seq bigint, model string, bytes bigint, tokens bigint, clipped boolean"
    spark.createDataFrame([(i, "m", i, 1, False) for i in range(1, 11)] + [(11, "m", 5, 1, True)], schema).write.parquet(str(tmp_path / "in"))
    q = calibration_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("calibrated").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("calibrated").collect()[-1]
    assert (r.samples, r.clipped, r["min"], r.p10, r.median, r["mean"]) == (10, 1, 1.0, 2.0, 6.0, 5.5)


def test_chunks_leave_by_and_by():
    """What Python holds doesn't grow with the texts of a batch."""
    import tracemalloc

    import pyarrow as pa
    from fathomtext.operators import split as module

    def peak(texts):
        column, n = pa.array(texts), 0
        tracemalloc.start()
        for rows, columns in module._pieces(column, "", SplitOptions(max_bytes=60)):
            assert len(rows) == len(columns[0])
            n += len(rows)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    words = "some words of a text. " * 200
    few, many = peak([words] * 250), peak([words] * 1000)
    assert many[0] == 4 * few[0] and many[1] < 1.2 * few[1] and many[1] < 8 << 20


def test_split_df_and_split_chunks(spark):
    from fathomtext.operators.split import split_chunks, split_df
    from pyspark.sql import functions as F

    texts = ["one two three four. " * 9, None, "", " \n", "é" * 100, "# A\nbody of a\n# B\nbody of b", "last words"]
    df = spark.createDataFrame([(i, {"k": i}, t) for i, t in enumerate(texts)], "id bigint, m map<string,int>, text string").repartition(2)
    for o in (SplitOptions(max_bytes=30), SplitOptions(max_bytes=20, markdown=True), SplitOptions(max_tokens=3, tokenizer=tokens.count_words)):
        want = [(i, {"k": i}, t, *c) for i, t in enumerate(texts) if t is not None for c in split(t, "", o)]
        got = split_df(df, options=o, keep=("id", "m", "text"))
        assert got.columns == ["id", "m", "text", "text", "start", "end", "ordinal", "headings"]
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[6])) == want
        found = {r.id: r.c for r in df.select("id", split_chunks(F.col("text"), options=o).alias("c")).collect()}
        assert found == {i: None if t is None else [tuple(c) for c in split(t, "", o)] for i, t in enumerate(texts)}
    assert split_df(df.where("id < 0"), options=o, keep=("id",)).count() == 0
