"""Personal data by weak supervision, in SQL functions throughout.

Every text is scanned for candidate spans: those of the base patterns, and wider ones of the
same kinds (spelt-out addresses, national phone numbers, digit runs that fail the checksum)
and of a kind of the method's own, ``secret`` (long runs of mixed letters and digits, as keys
and access tokens are). Labelers vote on each candidate, 1, 0 (no opinion) or -1: the rule
(the base rule, where there is one), its shape, a gazetteer (known domain endings, number
prefixes, key prefixes), words before the span that announce such data, words before it that
announce something else, and the company of other personal data in the text.
Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability, and the posteriors train a logistic span classifier on span features. Patterns
and feature combinations are bounded (5 kinds, 3 ** 6 votes, 2 ** 9 features), so only such
small tables reach the driver, from all documents. Base spans always stay; the classifier
adds candidates that it is sure of, where they overlap neither a base span nor an added one
that starts before.

Spans are built in time linear in their number: offsets in runs of ``CHUNK`` matches, overlaps
by running maxima over the sorted spans of a row.

Defined cases: null text is empty; repeated rows are judged each on its own; an empty table
teaches nothing and gives an empty result; other columns aren't looked at. All offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.llm._spark import keep

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = 4
#: the base patterns, written so that no start inside a failed run is tried again (same leftmost matches, linear time)
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: wider candidates
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(])(?<![0-9+(][\x20().-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_.@-])(?=[A-Za-z_-]{0,60}[0-9])(?=[0-9_-]{0,60}[A-Za-z])[A-Za-z0-9_-]{20,}+(?![@.][A-Za-z0-9])",
}
#: fixed values: words that announce data of a kind, and words that speak against it
CONTEXT = {"email": "e-?mail|mail|contact|kontakt|correo|courriel", "ip": "ip|address|host|server|adresse", "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta", "phone": "tel|phone|call|mobile|fax|telefon|teléfono|téléphone", "secret": "token|secret|api[ _-]?key|key|password|passwd|pwd|bearer|authorization|credential|kennwort|passwort|contraseña|clave"}
_NUMBERS = "token|secret|key|version|serial|isbn|order|invoice|sha|md5"
AGAINST = {"email": _NUMBERS, "ip": _NUMBERS, "card": _NUMBERS, "phone": _NUMBERS, "secret": "sha|sha1|sha256|md5|commit|checksum|digest|hash|etag|uuid|version|serial|isbn|revision"}
#: fixed values: endings of domains, first digits of card numbers, first letters of keys
DOMAINS = r"(?i)(?:\.|\(dot\)|\[dot\]) ?(?:com|org|net|edu|gov|mil|int|info|biz|name|io|ai|co|app|dev|me|tv|de|at|ch|fr|be|lu|es|pt|it|nl|uk|ie|dk|se|no|fi|pl|cz|ru|jp|cn|kr|in|br|mx|ar|ca|au|nz|eu)$"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
KEY_STARTS = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|eyJ)"
FEATURES = ["bias", "long", "separated", "announced", "spoken_against", "known", "shaped", "ruled", "in_company"]
SURE = 0.9
CHUNK = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of a string of digits; doubling every second one from the right."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + _luhn_digit(F.substr(F.reverse(digits), i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.when(i % 2 == 0, twice).otherwise(d)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) > 3, False).otherwise(F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0")).cast("int") <= 255))
    if kind == "card":
        return F.when((n < 12) | (n > 19), False).otherwise(luhn(_digits(m)))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,end:int,m:string,before:string>>"


def _lengths(found: Column, between: Column) -> Column:
    return F.transform(found, lambda m, j: F.length(m) + F.length(F.element_at(between, j + 1)))


def _offsets(lengths: Column) -> Column:
    """Code points before each run of CHUNK matches, from those of each gap and match."""
    runs = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(lengths, i * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda x, n: x + n)
        return F.struct((acc["at"] + own).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(runs, start, step, lambda acc: acc["out"])


def _spans(kind: str, found: Column, between: Column, offsets: Column, base: bool) -> Column:
    """array<struct<start, k, end, base, m, before>> of the matches, from the pieces between them."""

    def step(acc: Column, i: Column) -> Column:
        gap, m = F.element_at(between, i), F.element_at(found, i)
        a = acc["at"] + F.length(gap)
        return F.struct((a + F.length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("m"), F.right(gap, F.lit(24)).alias("before")))).alias("out"))

    def run(at: Column, i: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.sequence(i * CHUNK + 1, F.least((i + 1) * CHUNK, F.size(found))), start, step, lambda acc: acc["out"])

    spans = F.when(F.size(found) > 0, F.flatten(F.transform(offsets, run))).otherwise(F.array().cast(_SPANS))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), (_valid(kind, s["m"]) if base else F.lit(False)).alias("base"), F.lit(not base).alias("wide"), s["m"].alias("m"), s["before"].alias("before")))


def _lookup(table: dict[str, str], k: Column, value: Column) -> Column:
    out = F.lit(False)
    for kind, words in table.items():
        out = F.when(k == KINDS.index(kind), value.rlike(rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})[^\p{{L}}]*$")).otherwise(out)
    return out


def _judged(s: Column, n_base: Column) -> Column:
    """A candidate with its votes and features; n_base: base spans of its text."""
    k, m, n = s["k"], s["m"], F.length(_digits(s["m"]))
    announced, against = _lookup(CONTEXT, k, s["before"]), _lookup(AGAINST, k, s["before"])
    known = F.when(k == 0, m.rlike(DOMAINS)).when(k == 2, _digits(m).rlike(CARD_STARTS)).when(k == 3, m.rlike(r"^\+|^\(")).when(k == 4, m.rlike(KEY_STARTS)).otherwise(~m.rlike(r"^(?:0|127|255)\."))
    hexadecimal = m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
    mixed = (100 * n >= 12 * F.length(m)) & ~m.rlike(r"[A-Za-z]{3,}[-_][A-Za-z]{3,}")
    shaped = F.when(k == 0, F.length(m) <= 254).when(k == 1, ~m.rlike(r"(?:^|\.)0[0-9]")).when(k == 2, n.isin(15, 16)).when(k == 4, hexadecimal | mixed).otherwise((n >= 10) & (n <= 13))
    long = F.when(k == 0, F.length(m) > 20).when(k == 4, F.length(m) >= 32).otherwise(n > 12)
    company = n_base > F.when(s["base"], 1).otherwise(0)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    off = F.lit(False)
    ruled = F.when(k == 4, hexadecimal).otherwise(s["base"])
    votes = [vote(ruled, ~ruled & ~s["wide"]), vote(shaped, ~shaped), vote(known, ~known & (k != 4)), vote(announced, off), vote(off, against), vote(company, off)]
    flags = [F.lit(1), long.cast("int"), m.rlike(r"[\x20()-]").cast("int"), announced.cast("int"), against.cast("int"), known.cast("int"), shaped.cast("int"), (ruled | (s["wide"] & (k != 4))).cast("int"), company.cast("int")]
    return F.struct(s["start"].alias("start"), k.alias("k"), s["end"].alias("end"), s["base"].alias("base"), F.array(*votes).alias("v"), F.array(*flags).alias("f"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (all candidates of the text) of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scans = [(kind, pattern, table is BASE) for kind in KINDS for table in (BASE, WIDE) if (pattern := table.get(kind))]
    some = F.col("text").rlike(r"(?i)[0-9@]|\(at\)|\[at\]")
    # matches and the pieces between them are columns of their own, so that each text is scanned once a pattern
    pieces = []
    for i, (_, pattern, _) in enumerate(scans):
        pieces.append(F.when(some, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")).alias(f"m{i}"))
    d = d.select("doc_id", "text", *pieces)
    d = d.select("*", *(F.when(F.size(f"m{i}") > 0, F.split("text", pattern, -1)).alias(f"b{i}") for i, (_, pattern, _) in enumerate(scans)))
    d = d.select("*", *(F.when(F.size(f"m{i}") > 0, _lengths(F.col(f"m{i}"), F.col(f"b{i}"))).alias(f"l{i}") for i in range(len(scans))))
    d = d.select("*", *(F.when(F.size(f"m{i}") > 0, _offsets(F.col(f"l{i}"))).alias(f"o{i}") for i in range(len(scans))))
    spans = F.concat(*(_spans(kind, F.col(f"m{i}"), F.col(f"b{i}"), F.col(f"o{i}"), base) for i, (kind, _, base) in enumerate(scans)))
    d = d.select("doc_id", spans.alias("c"))
    d = d.select("doc_id", "c", F.size(F.filter("c", lambda s: s["base"])).alias("n"))
    return d.select("doc_id", F.transform("c", lambda s: _judged(s, F.col("n"))).alias("c"))


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[int, tuple[float, list[dict[int, float]]]]:
    """Per kind: log prior odds and, per labeler, log likelihood ratios of its votes; from counts of vote patterns."""
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        total = sum(n for _, n in rows)
        width = len(rows[0][0])
        post = [1 / (1 + math.exp(-(2 * v[0] + sum(v[1:])))) for v, _ in rows]
        for _ in range(rounds):
            pos = sum(p * n for p, (_, n) in zip(post, rows, strict=True))
            prior = math.log((pos + 1) / (total - pos + 1))
            ratios = []
            for j in range(width):
                r = {}
                for vote in (-1, 0, 1):
                    a = sum(p * n for p, (v, n) in zip(post, rows, strict=True) if v[j] == vote) + 1
                    b = sum((1 - p) * n for p, (v, n) in zip(post, rows, strict=True) if v[j] == vote) + 1
                    r[vote] = math.log(a / (pos + 3)) - math.log(b / (total - pos + 3))
                ratios.append(r)
            post = [1 / (1 + math.exp(-max(-30, min(30, prior + sum(r[x] for r, x in zip(ratios, v, strict=True)))))) for v, _ in rows]
        out[kind] = (prior, ratios)
    return out


def train(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic weights from (features, rows, sum of posteriors), by full gradient steps."""
    w = [0.0] * len(FEATURES)
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(steps):
        g = [ridge * x for x in w]
        for f, n, p in rows:
            y = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True))))
            for j, x in enumerate(f):
                g[j] += (y * n - p) * x / total
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def _posterior(model, k: Column, v: Column) -> Column:
    out = F.lit(0.0)
    for kind, (prior, ratios) in model.items():
        score = F.lit(prior)
        for j, r in enumerate(ratios):
            score = score + F.when(v[j] == 1, r[1]).when(v[j] == -1, r[-1]).otherwise(r[0])
        out = F.when(k == kind, 1 / (1 + F.exp(-score))).otherwise(out)
    return out


def classify(found: DataFrame) -> dict[int, list[float]]:
    """Per kind the classifier's weights, learnt from all candidates."""
    each = found.select(F.explode("c").alias("s")).select("s.k", "s.v", "s.f")
    patterns = [(r.k, tuple(r.v), r.n) for r in each.groupBy("k", "v").agg(F.count("*").alias("n")).collect()]
    soft = each.withColumn("p", _posterior(estimate(patterns), F.col("k"), F.col("v")))
    seen = soft.groupBy("k", "f").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    return {k: train([(tuple(r.f), float(r.n), r.p) for r in seen if r.k == k]) for k in sorted({r.k for r in seen})}


def find(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, base (base spans) and spans (with the added ones) of every row, sorted by start, then kind."""
    found = keep(candidates(docs, **names).withColumn("rid", F.monotonically_increasing_id()), "candidates")  # written, so rid stands
    weights = classify(found)

    def sure(s: Column) -> Column:
        out = F.lit(False)
        for kind, w in weights.items():
            score = sum((s["f"][j] * x for j, x in enumerate(w)), F.lit(0.0))
            out = F.when(s["k"] == kind, 1 / (1 + F.exp(-score)) >= SURE).otherwise(out)
        return out

    def span(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))

    # of rows with an added span, all spans in order: overlaps show in running maxima and minima
    open_ = found.where(F.exists("c", lambda s: ~s["base"] & sure(s))).select("rid", F.explode("c").alias("s"))
    open_ = open_.where(F.col("s.base") | sure(F.col("s"))).select("rid", span(F.col("s")).alias("x"), F.col("s.base").alias("base"))
    order = [F.col("x.start"), F.col("base").desc(), F.col("x.end"), F.col("x.k")]
    behind = Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("rid").orderBy(F.col("x.start").desc(), F.col("base"), F.col("x.end").desc(), F.col("x.k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    open_ = open_.withColumn("reach", F.max("x.end").over(behind)).withColumn("next", F.min(F.when(F.col("base"), F.col("x.start"))).over(ahead))
    added = open_.where(~F.col("base") & (F.coalesce("reach", F.lit(0)) <= F.col("x.start")) & (F.col("next").isNull() | (F.col("next") >= F.col("x.end"))))
    added = added.groupBy("rid").agg(F.collect_list("x").alias("added"))
    base = F.transform(F.filter("c", lambda s: s["base"]), span)
    d = found.select("doc_id", "rid", base.alias("b")).join(added, "rid", "left")
    return d.select("doc_id", F.array_sort("b").alias("base"), F.array_sort(F.when(F.col("added").isNull(), F.col("b")).otherwise(F.concat("b", "added"))).alias("spans"))


def spelt(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans; and n_spans, n_added, private (whether there is any span)."""
    d = find(docs)

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == i)).cast("bigint")

    more = [F.size("spans").cast("bigint").alias("n_spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"), (F.size("spans") > 0).alias("private")]
    return d.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE_KINDS])), F.sha2(F.encode(spelt(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"), *more)


def redact(docs: DataFrame, spans: str = "spans", text: str = "text") -> Column:
    """The text with each span replaced by its kind in brackets; for a row that has both columns."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate(spans, start, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["k"] + 1)).alias("out"))))
    return F.concat(end["out"], F.substring(F.col(text), end["at"] + 1, F.length(text)))
