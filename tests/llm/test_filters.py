"""Toxicity, quality, URLs and languages: planted cases, brute force, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.llm import language, logistic, rules, toxicity, url_filter
from sitelake.llm.labelled import labelled_sample, remainder
from sitelake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, score string, label string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, a repeated row, a very long text, and columns whose names clash."""
    rows = [(1, None, "s", "l"), (2, "", "s", "l"), (None, "you moron", "s", "l"), (3, "you moron", "s", "l"), (3, "you moron", "s", "l"), (4, "fine words " * 200_000, "s", "l"), (5, " \n\t ", "s", "l")]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = [(i, f"some plain text number {i} of words", 0) for i in range(60)] + [(100 + i, f"some plain moron text number {i}", 1) for i in range(30)] + [(200 + i, "", 0) for i in range(60)]
    return toxicity.train_toxicity(spark.createDataFrame(rows, "doc_id long, text string, label int"))


def test_logistic_fit_finds_the_minimum():
    random = np.random.default_rng(1)
    x = random.normal(size=(400, 5))
    y = (random.random(400) < logistic.sigmoid(x @ np.array([2.0, -1, 0, 0, 0.5]) + 0.3)).astype(float)
    w, b = logistic.fit(logistic.Dense(x), y, l2=0.01, rounds=2000)
    errors = logistic.sigmoid(x @ w + b) - y
    assert np.abs(x.T @ errors / 400 + 0.01 * w).max() < 1e-4 and abs(errors.mean()) < 1e-4
    sparse, _ = logistic.fit(logistic.Dense(x), y, l1=0.1, rounds=2000)
    assert (sparse == 0).sum() >= 2
    rows, cols = np.nonzero(x)
    same, _ = logistic.fit(logistic.Sparse(np.arange(0, 2001, 5), cols, x[rows, cols], 5), y, l2=0.01, rounds=2000)
    assert np.allclose(same, w, atol=1e-4)


def test_toxicity_of_odd_rows(spark, odd, toxic_model):
    scores = toxicity.score_toxicity(odd, toxic_model).collect()
    assert len(scores) == 7
    by = {}
    for r in scores:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1] == by[2] and by[3][0] == by[3][1] == by[None][0]
    assert by[3][0] >= toxicity.THRESHOLD > by[4][0]
    kept = toxicity.drop_toxic_rows(odd, toxic_model)
    assert kept.schema == odd.schema and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]
    assert toxicity.score_toxicity(odd.limit(0), toxic_model).count() == 0


def test_toxicity_counts_each_bucket_of_a_text_once(toxic_model):
    texts = [b"moron moron", b"", b"mor"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    text, bucket = toxicity._present(data, offsets, (3,), 20, None)
    assert (text == 0).sum() == len({b"moron moron"[i : i + 3] for i in range(9)}) and (text == 1).sum() == 0 and (text == 2).sum() == 1
    assert bucket[text == 2][0] in bucket[text == 0]


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, note string")
    out = toxicity.toxicity(odd, none)
    assert out.count() == 7
    one_kind = spark.createDataFrame([(3, 1), (4, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(odd, one_kind).collect()} == {1}


def test_held_out_toxicity(spark):
    out = QUERIES["op8_toxicity"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    row = out.filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 50 and row["right"] >= 0.9
    assert out.filter("held_out != (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 0


def test_labelled_sample_is_bounded_and_joins_each_row(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 5, 5)] + [(None, 0)], "doc_id long, toxic int")
    assert labelled_sample(odd, labels, "toxic", F.lit(True), 2).select("doc_id").distinct().count() == 2
    assert labelled_sample(odd, labels, "toxic", F.lit(True), 99).count() == 6  # the repeated row twice, the repeated label once
    assert labelled_sample(odd, labels, "toxic", remainder(F.col("doc_id"), 4) == 99, 9).count() == 0


def test_rules_as_expression_equal_rules_as_arrays(spark, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = rules.train_rules(labelled_sample(docs, labels, "quality", F.lit(True), 400))
    assert model.rules
    both = docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    table = rules.text_statistics(both).select(rules.rule_score(model).alias("score"), *rules.STATISTICS).toPandas()
    x = table[list(rules.STATISTICS)].to_numpy()
    total = model.intercept + sum(w * rules.holds(r, x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(logistic.sigmoid(total), table["score"])
    assert len(table) == both.count()


def test_statistics_of_a_text(spark):
    docs = spark.createDataFrame([(1, "The cat. THE cat\nThe cat. THE cat\n 12 %%"), (2, None), (3, "")], "doc_id long, text string")
    a, b, c = rules.text_statistics(docs).orderBy("doc_id").collect()
    assert a["different_words"] == pytest.approx(6 / 10) and a["different_lines"] == pytest.approx(2 / 3)
    assert a["sign_share"] == pytest.approx(2 / 40) and a["digit_share"] == pytest.approx(2 / 40) and a["upper_share"] == pytest.approx(8 / 40)
    assert tuple(b)[1:] == tuple(c)[1:] == (0.0,) * 9


def test_held_out_quality(spark):
    out = QUERIES["op7_quality_rules"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    row = out.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 50 and row["right"] >= 0.9
    assert out.filter("score < 0 or score > 1 or (predicted = 1) != (score >= 0.3)").count() == 0


def test_quality_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in rules.quality(odd, none).collect()} == {0.5}
    assert rules.quality(odd.limit(0), none).count() == 0


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
        ("http://net/", "net", "/", "net/"),
        ("http://x.net", "x.net", "", None),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"),
        ("http://myexample.com/de/1", "myexample.com", "/de/1", None),
        ("http://a.org/fr/2", "a.org", "/fr/2", "org/fr/"),
        ("http://a.org#/fr/2", "a.org", "", None),
        ("x\ny://h/p://q", "h", "/p://q", None),
        ("no scheme", "", "", None),
        ("://", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ],
)
def test_url_parts_and_rules(value, url, host, path, rule):
    known = ["net/", "example.net/en/", "example.com/de/", "org/fr/"]
    assert value(url_filter.url_host, url) == host and value(url_filter.url_path, url) == path
    assert value(lambda u: url_filter.matching_rule(url_filter.url_host(u), url_filter.url_path(u), known), url) == rule


def test_urls_are_judged(spark):
    labelled = spark.createDataFrame([(f"http://casino{i}.example/win", 1) for i in range(30)] + [(f"http://garden{i}.example/rose", 0) for i in range(30)], "url string, label int")
    model = url_filter.train_urls(labelled)
    pages = spark.createDataFrame([(1, "http://casino99.example/win", "c"), (2, "http://garden99.example/rose", "c"), (3, None, "c"), (None, "http://casino.net/", "c"), (1, "http://casino99.example/win", "c")], "page_id long, url string, score string")
    out = url_filter.judge_urls(pages, model, ["net/"], ["example.net/"])
    got = sorted((r["page_id"] or 0, r["verdict"], r["rule"]) for r in out.collect())
    assert [g[:2] for g in got if g[0] != 3] == [(0, "block"), (1, "block"), (1, "block"), (2, "allow")] and got[0][2] == "net/"
    empty = url_filter.train_urls(labelled.limit(0))
    assert {r["score"] for r in url_filter.judge_urls(pages, empty, [], []).collect()} == {0.5}
    assert url_filter.judge_urls(pages.limit(0), model, [], []).count() == 0


def test_whole_pages_table_is_judged(spark):
    out = QUERIES["op6_url_filter"](spark, SMALL)
    assert out.count() == spark.read.parquet(f"{SMALL}/pages.parquet").count() and out.filter("verdict is null or verdict not in ('allow', 'block')").count() == 0
    assert out.filter("rule is null and host like '%casino-win%' and verdict = 'allow'").count() == 0


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(i, "the house and the garden of the king", "en") for i in range(20)] + [(50 + i, "das haus und der garten des königs", "de") for i in range(20)]
    return language.train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_text_likelihood_equals_a_plain_sum(spark, tongues):
    text = "The garden\nund das Haus"
    got = language.text_evidence(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), tongues, evidence=1e9).orderBy("doc_id").collect()
    data = language._letters(np.frombuffer(text.encode(), np.uint8))
    want = sum(p[language.ngram_buckets(data, n, tongues.bits)].astype(float).sum(axis=0) for n, p in zip(tongues.orders, tongues.log_p))
    assert np.allclose(got[0]["likelihood"], want, rtol=1e-5) and got[1]["likelihood"] == [0.0, 0.0]


def test_page_evidence_decides_where_text_does_not(spark, tongues):
    german = [(i, f"http://a.beispiel.de/{i}", "<html lang=de><body>das haus und der garten</body>") for i in range(20)]
    english = [(100 + i, f"http://a.example.com/{i}", '<html lang="en-GB"><p>the house and the garden</p>') for i in range(20)]
    bare = [(200, "http://a.beispiel.de/x", "<p>1 2 3</p>"), (201, "http://b.other.com/y", "<html lang='de'><p>7</p>"), (202, None, None), (203, "http://a.example.com/z", "<script>das haus und der garten</script>"), (None, "", "")]
    out = language.page_languages(spark.createDataFrame(german + english + bare, "page_id long, url string, html string"), tongues)
    got = {r["page_id"]: r["lang"] for r in out.collect()}
    assert len(got) == 45 and got[200] == "de" and got[203] == "en" and got[3] == "de" and got[103] == "en"
    assert got[201] == "de"  # declared, although its suffix speaks for English
    assert got[202] in ("de", "en")


def test_languages_of_all_documents_and_pages(spark):
    out = QUERIES["op5_language"](spark, SMALL).cache()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("lang").alias("want"))
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)', 1).alias("want"))
    for table, key in ((docs, "doc_id"), (pages, "page_id")):
        row = out.join(table, key).agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("want")).cast("int")).alias("right")).first()
        assert row["n"] == table.count() and row["right"] > 0.97


def test_languages_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a", None)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert [(r["doc_id"], r["lang"]) for r in language.languages(docs, pages).orderBy("doc_id").collect()] == [(1, None), (2, None)]
