"""Every registered query of the core against its SQL, on the smallest tables."""

from collections import Counter

import pytest
from fathomtext.plans import queries as plans

from tests.conftest import SF


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = sql.execute(plans.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_every_vector_is_a_query(spark, monkeypatch):
    from fathomtext.functions import vectors
    from fathomtext.operators import pairs, rerank
    from pyspark.sql import functions as F

    monkeypatch.setattr(pairs, "PER_BLOCK", 40)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 120").select("vec_id", "embedding")
    odd = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [1.0, 2.0]), (1004, [1.0] * 64), (1005, [1.0] * 64), (1006, [1.0] * 64), (None, [1.0] * 64)]
    e = e.unionByName(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>"))
    b = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    brute = e.crossJoin(b).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_index"), F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))

    def rows(df):
        return Counter(map(tuple, df.collect()))

    assert rows(pairs.all_pairs(e).select("query_id", "doc_index", "score")) == rows(brute)
    for n in (1, 3, 10):
        got, want = rerank.rank(pairs.all_pairs(e, most=n), n), rerank.rank(brute, n)
        assert rows(got.select("query_id", "doc_index", "score", "rank")) == rows(want.select("query_id", "doc_index", "score", "rank"))
    assert pairs.all_pairs(e.limit(0)).count() == 0
    some = brute.where("query_id % 100 = 0")
    assert rows(pairs.all_pairs(e, queries="id % 100 = 0").select("query_id", "doc_index", "score")) == rows(some) and some.count() > 0
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for name, each in (("cosine_pairs", n - 1), ("cosine_topk", 10), ("sigmoid_scores", n - 1), ("rerank_topn", 3), ("rerank_ties", n - 1)):
        assert [r["count"] for r in plans.queries()[name](spark, SF).groupBy("query_id").count().collect()] == [each] * -(-n // 100)


BLANK = " \t\n\r"


def brute_spans(text, most, overlap, by_tokens=0):
    """Spans by looking at each place between code points: the last paragraph, line, sentence or word end that fills half the window."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    n, out, start, last = at[-1], [], 0, -1
    if not text.strip():
        return []

    def floor(b):
        return max(p for p in at if p <= b)

    def put(a, b):
        i, j = at.index(a), at.index(b)
        while i < j and text[i] in BLANK:
            i += 1
        while j > i and text[j - 1] in BLANK:
            j -= 1
        if i < j:
            out.append((at[i], at[j]))
        return i < j

    if n <= most and not by_tokens:
        put(0, n)
        return out
    while start < n:
        limit, first = min(start + most, n), at.index(start)
        if by_tokens:
            limit = min(limit, max(start + len(brute_cut(text[first:], by_tokens).encode()), at[first + 1]))
        if limit >= n:
            break
        least = start + (limit - start) * 50 // 100
        inside = [k for k in range(first + 1, len(at)) if at[k] <= limit]
        kinds = (
            [k for k in inside if k - 2 >= first and text[k - 2 : k] == "\n\n"],
            [k for k in inside if text[k - 1] == "\n"],
            [k for k in inside if at[k] < limit and text[k - 1] in ".!?" and text[k] in BLANK],
            [k for k in inside if at[k] < limit and text[k] in BLANK],
        )
        end = next((at[k[-1]] for k in kinds if k and at[k[-1]] > least), floor(limit))
        if put(start, end):
            last = out[-1][0]
        following = floor(end - overlap)
        start = end if following <= start or following <= last else following
    if start < n:
        put(start, n)
    return out


def brute_cut(text, most):
    """The bisection to match, over code points: the step is by bytes and ends where it lands behind the lower bound."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    if len(text.split()) <= most:
        return text
    low, high = 0, len(at) - 1
    while low < high:
        mid = max(k for k in range(len(at)) if at[k] <= (at[low] + at[high] + 1) // 2)
        if mid <= low:
            break
        if len(text[: at.index(at[mid])].split()) <= most:
            low = mid
        else:
            high = max(k for k in range(len(at)) if at[k] <= at[mid] - 1)
    return text[:low]


def test_multibyte_documents(spark, tmp_path):
    import random

    r = random.Random(3)
    alphabet = ["é", "ü", "日本", "🙂", "word", "straße", " ", " ", " ", "\n", "\n\n", ". ", "! ", "\t", "ñ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 1500))) for _ in range(40)] + ["日" * 1000, "é" * 512, "é" * 513, "🙂 " * 30, "", "  \n", "x" * 3000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), SF):
        docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert sum(t is not None and not t.isascii() for _, t in docs) > 30
        cut = {x.doc_id: x.text for x in plans.queries()["token_truncate_words"](spark, sf).collect()}
        assert cut == {i: None if t is None else brute_cut(t, 10).rstrip(" ") for i, t in docs}
        few = [(i, t) for i, t in docs if t is not None and len(t) < 6000]
        for name, overlap in (("split_bytes", 0), ("split_overlap", 128), ("split_full", 128)):
            texts_of = {i: t.encode() for i, t in docs if t is not None}
            rows = plans.queries()[name](spark, sf).collect()
            if name == "split_full":
                got = Counter((x.doc_id, x.ordinal, x.start, x.end, x.text) for x in rows)
            else:
                got = Counter((x.doc_id, x.ordinal, x.cs, x.ce, texts_of[x.doc_id][x.cs : x.ce].decode()) for x in rows)
            assert {k[0] for k in got} == {i for i, t in docs if t and t.strip()}
            want = Counter((i, k, a, b, t.encode()[a:b].decode()) for i, t in few for k, (a, b) in enumerate(brute_spans(t, 1024, overlap)))
            ids = {i for i, _ in few}
            assert Counter({k: n for k, n in got.items() if k[0] in ids}) == want


def test_split_by_tokens_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = plans.queries()["split_tokens"](spark, SF).collect()
    few = {i: t for i, t in texts.items() if t is not None and len(t) < 2500}
    assert len(few) > 50 and {r.doc_id for r in rows} == {i for i, t in texts.items() if t and t.strip()}
    want = Counter((i, k, a, b, t.encode()[a:b].decode()) for i, t in few.items() for k, (a, b) in enumerate(brute_spans(t, len(t.encode()), 0, 100)))
    assert Counter((r.doc_id, r.ordinal, r.start, r.end, r.text) for r in rows if r.doc_id in few) == want


def test_odd_texts_against_sql(spark, tmp_path):
    """Fences that open in other fences, both kinds of headings, empty titles, Unicode white space, multibyte texts."""
    import random

    duckdb = pytest.importorskip("duckdb")
    r = random.Random(11)
    lines = ["# One", "## Two ##", "   ### Three", "    # code", "#", "# ", "#None", "####### seven", "Über", "===", "---", " == ", "- x", "```", "````", "~~~", "~~~~ x", "\t```", "", "", " ", "\u00a0", "\f", "日本 語", "#\u3000wide", "# \u3000", "#\ttab", "## a # b", "word word. Word! ", "é" * 30, "x" * 90]
    talks = [(i // 3, i % 3, "user", "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for i in range(300)]
    spark.createDataFrame([*talks, (1000, 0, "user", None), (1001, 0, "user", "")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    bits = ["é", "日本", "🙂", "word", " ", " ", "\n", "\n\n", ". ", "! ", "\t", "ß" * 20]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 1200))) for _ in range(150)] + ["", " \n", "日" * 1000, "x" * 1100, "a" * 990 + " b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("headings", "split_markdown", "split_minbytes", "split_full", "split_sql", "embed_hash", "embed_shrinking"):
        df = plans.queries()[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        found = con.execute(plans.oracle_sql()[name])
        names = [x[0] for x in found.description]
        want = Counter(tuple(plain(x[names.index(c)]) for c in cols) for x in found.fetchall())
        assert want and Counter(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want, name


ODD_RECORDS = [(1, "x", "en", "web"), (2, "", "en", "web"), (3, "x", "", "web"), (4, "x", "en", ""), (5, "x", None, "web"), (6, "", "", ""), (7, None, "en", "web"), (8, " \n", "en", "web")]


def odd_records(spark, tmp_path, name):
    spark.createDataFrame(ODD_RECORDS, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r.record for r in plans.queries()[name](spark, str(tmp_path)).collect()}


def test_records_of_empty_texts_and_fields(spark, tmp_path):
    """The reference leaves out empty fields, and the blank line if the body is empty; the SQL hasn't these cases."""
    want = {1: "lang: en\nsource: web\n\nx", 2: "lang: en\nsource: web", 3: "source: web\n\nx", 4: "lang: en\n\nx", 5: "source: web\n\nx", 6: "", 7: None, 8: "lang: en\nsource: web\n\n \n"}
    assert odd_records(spark, tmp_path, "format_record") == want


def test_records_for_a_task_of_empty_texts_and_fields(spark, tmp_path):
    want = {1: "lang: en\n\nx", 2: "lang: en", 3: "x", 4: "lang: en\n\nx", 5: "x", 6: "", 8: "lang: en\n\n \n"}
    assert odd_records(spark, tmp_path, "format_record_for_task") == {k: f"clustering:\n{v}" for k, v in want.items()} | {7: None}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_ranks_without_moving_pairs(spark, monkeypatch, kind):
    """Ranks by counts are those of a window over all pairs, with odd vectors and ids that occur twice, as queries, too."""
    from fathomtext.operators import pairs, rerank
    from pyspark.sql import functions as F

    monkeypatch.setattr(pairs, "PER_BLOCK", 40)
    monkeypatch.setattr(pairs, "PER_RANGE", 25)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 230").select("vec_id", "embedding")
    odd = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [1.0, 2.0]), (1004, [1.0] * 64), (1005, [1.0] * 64), (1005, [-1.0] * 64), (1006, [1.0] * 64), (None, [1.0] * 64), (7, None), (7, [0.5] * 64), (8, [1.0] * 64)]
    e = e.unionByName(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>")).withColumn("vec_id", F.col("vec_id").cast(kind))
    for queries, digits in (("true", 1), ("id % 100 = 0", 1), ("id % 5 = 0 OR id = 7", 3)):
        want = rerank.rank(pairs.all_pairs(e, queries=queries).withColumn("score", F.round("score", digits)))
        got = pairs.ranked_pairs(e, queries=queries, digits=digits)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        found = Counter(map(tuple, got.collect()))
        assert found == Counter(map(tuple, want.collect())) and len(found) > 400
    assert pairs.ranked_pairs(e.limit(0)).count() == 0
    assert pairs.ranked_pairs(e.where("vec_id = 3")).count() == 0


def test_rerank_ties_moves_no_pairs(spark):
    """What makes the pairs is the last step: no window and no exchange comes after it."""
    plan = plans.queries()["rerank_ties"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    after = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Exchange" not in after and "Window" not in after


def test_runs_of_one_id_stay_together(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from fathomtext.operators import pairs

    r = np.random.default_rng(4)
    q, d = pa.array([1, 2, 2, 2, 3, 5, 5, 9]), pa.array(list(range(40)))
    qv, dv = (pa.array(r.normal(size=(n, 3)).tolist(), pa.list_(pa.float32())) for n in (8, 40))

    def found(n):
        monkeypatch.setattr(pairs, "QUERIES_AT_ONCE", n)
        parts = list(pairs._ordered(q, qv, d, dv, 1))
        return len(parts), [np.concatenate(x).tolist() for x in zip(*parts, strict=True)]

    whole = found(100)
    assert whole[0] == 1 and found(2) == (3, whole[1]) and found(1)[1] == whole[1]
