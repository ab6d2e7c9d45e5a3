"""Operators with a fitted model: exact parts against brute force, the rest by held-out accuracy."""

import os

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import EDGES, frame, held_out, quality_base, save

from flowspark.llm import catalog, language, quality, urls

TABLES = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables absent")
LABELS = "doc_id long, quality int, toxic int"


def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def test_base_rules_equal_brute_force(spark, tmp_path):
    rows = EDGES + [(30, "x y z\nx y z\n\nx  y z"), (31, "a b c a b c " * 20), (32, "# * $ %\n# * $ %"), (33, "\n\n\n")]
    folder = save(spark, tmp_path / "t", rows, labels=no_labels(spark))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(((r.doc_id, *[r[n] for n in names]) for r in catalog.op5_quality_lines(spark, folder).collect()), key=str)
    assert got == sorted(((d, *quality_base(t)) for d, t in rows), key=str)


def test_chain_learns_and_decodes_by_brute_force():
    rng = np.random.default_rng(5)
    rows = np.repeat(np.arange(60), rng.integers(1, 9, 60))
    labels = rng.integers(0, 2, len(rows))
    features = np.c_[np.ones(len(rows)), labels + rng.normal(0, 0.4, len(rows))]
    chain = quality.Chain(2).fit(features, labels, rows, 60)
    states = chain.decode(features, rows, 60)
    assert np.mean(states == (labels == 1)) > 0.8
    for text in range(60):
        at = np.flatnonzero(rows == text)
        scores = features[at] @ chain.weights
        best = max((sum(scores[k, s] for k, s in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])), path)
                   for path in np.ndindex(*[2] * len(at)))
        assert tuple(states[at].astype(int)) == best[1]


@needs_tables
def test_good_documents_are_kept(spark):
    rated = catalog.op5_quality_lines(spark, TABLES).where("NOT base_failed").join(
        spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rated if r.quality == 1]
    poor = [r.kept for r in rated if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.2


def test_quality_of_no_documents(spark, tmp_path):
    docs = frame(spark, EDGES).limit(0)
    assert quality.rate(docs, quality.fit(docs, no_labels(spark))).collect() == []
    clash = frame(spark, [(1, "w " * 60)]).selectExpr("*", "'k' AS kept", "3 AS label")
    row = quality.rate(clash, None).first()
    assert row.label == 3 and row.kept is False and row.n_words == 60


@needs_tables
def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    rows = catalog.op6_language(spark, TABLES).collect()
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id) for r in rows)
    tested = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(tested) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_undetermined_languages(spark, tmp_path):
    rows = [(d, t, "en") for d, t in EDGES] + [(50 + k, f"das ist ein deutscher satz nummer {k}", "de") for k in range(8)]
    rows += [(70, "123 --- 456", "en"), (71, "漢字", None), (72, "1234 ¼ ½", "xx")]
    folder = save(spark, tmp_path / "t", rows)
    found = {r.doc_id: r for r in catalog.op6_language(spark, folder).collect()}
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {1, 2, 3, 70, 72}
    assert found[71].lang_pred in ("de", "en")
    empty = frame(spark, rows).limit(0)
    assert language.identify(empty, language.fit(empty)).collect() == []
    alone = language.identify(frame(spark, [(1, "text")]), language.fit(frame(spark, [(1, "text", None)])))
    assert alone.first().lang_pred == "und"


def test_kernel_of_presence_rows():
    parts = [b"abcd", b"bcde", b"zz"]
    data, starts = np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]
    x = language.unit_rows(language.presence(data, starts, starts[1:]))
    grams = [{p[k: k + n] for n in language.ORDERS for k in range(len(p) - n + 1)} for p in parts]
    wanted = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in grams] for a in grams]
    assert np.allclose(x @ x.T, wanted, atol=1e-5)


def test_scores_do_not_depend_on_the_batch(spark):
    texts = [t for _, t in EDGES] + ["deutsch und englisch gemischt " * 300]
    model = language.Model(["a", "b"], np.random.default_rng(1).normal(size=(1 << language.BITS, 2)).astype(np.float32))
    whole = model.scores(pa.array(texts, pa.string()))
    single = np.concatenate([model.scores(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single, atol=1e-5)


URLS = [None, "", "no scheme.example.com/en/", "http://Example.COM/en/x?y#z", "https://www.example.com/en/1", "ftp://a.b.net/es/",
        "http://net/fr/a://b/c", "http://xnet/fr/", "http://a.com", "http://a.com?x/", "http://shop.example.com/en", "x://y.org/fr/1.html",
        "HTTP://ÄÖ.Net/es/", "://", "://com/", "http://example.com/EN/", "http://a\nb.com/\nc"]
WANTED = [("", "", None), ("", "", None), ("", "", None), ("example.com", "/en/x", "example.com/en/"),
          ("www.example.com", "/en/1", "www.example.com/en/"), ("a.b.net", "/es/", "net/es/"), ("net", "/fr/a://b/c", "net/fr/"),
          ("xnet", "/fr/", None), ("a.com", "", None), ("a.com", "", None), ("shop.example.com", "/en", "com/"),
          ("y.org", "/fr/1.html", None), ("ÄÖ.net", "/es/", "net/es/"), ("", "", None), ("com", "/", "com/"),
          ("example.com", "/EN/", "com/"), ("a\nb.com", "/\nc", "com/")]


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS label")
    rows = sorted(urls.judge(pages).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule) for r in rows] == WANTED
    for r in rows:
        assert r.verdict in ("allow", "block") and (r.block_score is None) == (r.rule is not None) and r.label == 1
        if r.rule:
            assert r.verdict == dict(urls.RULES)[r.rule]


def test_urls_with_one_label_or_none(spark):
    schema = "page_id long, url string"
    none = urls.judge(spark.createDataFrame([(1, "http://a.org/"), (2, None)], schema))
    assert {r.verdict for r in none.collect()} == {"allow"}
    blocked = urls.judge(spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/es/1")], schema))
    assert {r.verdict for r in blocked.collect()} == {"block"}
    assert urls.judge(spark.createDataFrame([], schema)).collect() == []


@needs_tables
def test_url_query_covers_all_pages(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    rows = catalog.op7_url_filter(spark, TABLES).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.select("page_id").collect())


def test_url_statistics_count_all_labelled_urls(spark, monkeypatch):
    rows = [f"http://h{k}.{'net' if k % 4 else 'com'}/{k}{'.html' if k % 3 else '.php'}" for k in range(240)] + ["http://h1.net/1.html"] * 50
    found, shares = {}, urls.blocked_share

    def watched(df, key):
        found[key] = {r[key]: r[f"{key}_blocked"] for r in shares(df, key).collect()}
        return shares(df, key)

    monkeypatch.setattr(urls, "blocked_share", watched)
    pages = spark.createDataFrame([(u,) for u in rows], "url string")
    judged = urls.judge(pages, [("net/", "block"), ("com/", "allow")], fit_rows=60)
    assert judged.count() == len(rows)
    assert found["suffix"] == {"net": 181 / 182, "com": 1 / 62}
    assert found["ending"] == {".html": 121 / 162, ".php": 61 / 82}


def test_lexical_features(spark):
    page = spark.createDataFrame([("http://ab.com/a1/b2.html?x=1&y=2#f",)], "url string")
    host, path = urls.host_and_path(page.url)
    row = urls.lexical(page.withColumns({"host": host, "path": path})).first()
    text = "http://ab.com/a1/b2.html?x=1&y=2#f"
    shares = [text.count(c) / len(text) for c in set(text)]
    assert row.entropy == pytest.approx(-sum(s * np.log2(s) for s in shares))
    assert (row.parameters, row.path_depth, row.host_depth, row.has_fragment, row.suffix, row.ending) == (2, 2, 1, 1, "com", ".html")
    assert row.digit_ratio == pytest.approx(4 / len(text))
