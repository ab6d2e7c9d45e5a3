import os
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import EDGES, frame, held_out

from flowspark.llm import catalog, toxicity

TABLES = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables absent")


def windows(*texts):
    return toxicity.Windows(pa.array(texts, pa.string()))


def brute_kernel(a, b):
    """Gap-weighted sequences of 3 and 4 bytes, spans up to SPAN, of two padded windows."""

    def features(text):
        data, out = (" " + text).ljust(64), {}
        for start in range(toxicity.WINDOW):
            for n in (2, 3):
                for rest in combinations(range(1, toxicity.SPAN), n):
                    key = (data[start], *[data[start + k] for k in rest])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (rest[-1] - n)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_equals_brute_force():
    texts = ["idiotic", "i.d.i.o.t", "harmless", "idiot"]
    slots = np.concatenate([windows(t).slots(np.array([0])) for t in texts])
    got = toxicity.kernel(slots, np.ascontiguousarray(toxicity.feature_rows(slots).T))
    wanted = [[brute_kernel(a, b) for b in texts] for a in texts]
    assert np.allclose(got, wanted, rtol=0.05, atol=1.5)  # hashing may join a few sequences


def test_scores_are_sums_over_windows_and_independent_of_the_batch():
    weights = np.random.default_rng(3).normal(size=1 << toxicity.BITS).astype(np.float32)
    texts = [t for _, t in EDGES]
    together, scores = windows(*texts), None
    scores = together.scores(weights)
    direct = (weights[together.slots(np.arange(len(together.starts)))] * toxicity.REPEATED_WEIGHTS).sum(axis=1)
    assert np.allclose(scores, direct, atol=1e-3)
    features, _ = together.document_features(scores)
    for k, text in enumerate(texts):
        alone = windows(text)
        assert np.allclose(features[k], alone.document_features(alone.scores(weights))[0][0], atol=1e-3)


def test_every_byte_of_a_word_is_in_a_window():
    w = windows("x" * 1000, "ab " * 40)
    for row, size in enumerate((1000, 120)):
        seen = {p for s in w.starts[w.rows == row] - w.places[row] for p in range(s, s + toxicity.WINDOW)}
        assert set(range(0, size)) <= seen


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in catalog.op1_toxicity(spark, TABLES).collect()}


@needs_tables
def test_held_out_documents(spark, scored):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in scored.items())
    tested = [(truth[d], r.predicted) for d, r in scored.items() if r.held_out and d in truth]
    caught, alarms = np.mean([p for t, p in tested if t]), np.mean([p for t, p in tested if not t])
    assert caught > 0.8 and alarms < 0.04


@needs_tables
def test_gaps_and_inserted_characters_are_tolerated(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{TABLES}/labels.parquet"))
    base = "The {} is with that and thing here. Of the and to that."
    words = ["idiot", "i.d.i.o.t", "id-iot", "idixot", "st-u-pid", "stupiid", "thing", "the", "with"]
    rows = toxicity.score(frame(spark, [(k, base.format(w)) for k, w in enumerate(words)]), model).collect()
    found = {words[r.doc_id]: r.toxicity for r in rows}
    assert min(found[w] for w in words[:6]) > 0.3 > max(found[w] for w in words[6:])


def test_without_labels_or_documents(spark):
    docs = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) is None
    clash = docs.selectExpr("*", "'t' AS toxicity", "1 AS label")
    rows = toxicity.score(clash, None).collect()
    assert len(rows) == len(EDGES) and {(r.toxicity, r.label) for r in rows} == {(0.0, 1)}
    some = spark.createDataFrame([(2, 1, 1), (3, 1, 0), (6, 1, 1), (8, 1, 0), (10, 1, None), (None, 1, 1), (4, 1, 1), (12, 0, 0)],
                                 "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, some)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), model).collect() == []
