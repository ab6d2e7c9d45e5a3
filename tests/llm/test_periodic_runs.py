import random

import pytest
from llm_brute import EDGES, frame, periodic_runs, run_facts, save

from flowspark.llm import catalog, periodic_runs as operator


def repetitive(rng, size, letters):
    words = []
    while len(words) < size:
        if rng.random() < 0.5:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8)
        else:
            words.append(rng.randrange(20))
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (3, 3), (10, 5), (1, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        words = repetitive(rng, rng.randrange(60), rng.choice([1, 2, 3, 5]))
        wanted = periodic_runs(words, least, exponent)
        assert operator.runs_of(words, least, exponent) == wanted
        assert operator.text_runs([str(w).encode() for w in words], least, exponent) == wanted


def test_long_texts_stay_cheap():
    same = [b"a"] * 60_000
    assert operator.text_runs(same, 6, 4) == [(0, 60_000, 1)]
    block = [str(k).encode() for k in range(7_000)]
    assert operator.text_runs([b"x", *block * 5, b"y"], 6, 4) == [(1, 35_000, 7_000)]


def rows():
    rng = random.Random(4)
    found = [(d, t) for d, t in EDGES] + [(30, "a b " * 9 + "c"), (31, "na " * 40), (32, "x a b a b a b a b a y"), (33, "a\tb\x0ba b\r\na b a  b")]
    for k in range(100, 320):
        found.append((k, " ".join(f"w{w}" for w in repetitive(rng, rng.randrange(80), 3))))
    return found


def test_query_equals_brute_force(spark, tmp_path):
    folder = save(spark, tmp_path / "t", rows())
    got = catalog.op12_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = [run_facts(d, t) for d, t in rows()]
    assert sum(w[1] > 1 for w in wanted) > 20
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(wanted, key=str)


def test_real_outputs_nulls_and_clashes(spark):
    docs = frame(spark, [(1, "so a b a b a b a b a end"), (2, None), (2, None), (3, "")]).selectExpr("*", "'x' AS runs", "5 AS p", "6 AS w")
    found = operator.find_runs(docs)
    got = sorted(found.collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in got[0]["runs"]] == [(1, 9, 2)] and got[0].collapsed_text == "so a b end" and got[0].n_words == 11
    assert [(r.n_words, r["runs"], r.collapsed_text, r.p, r.w) for r in got[1:]] == [(0, [], "", 5, 6)] * 3
    assert operator.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        operator.find_runs(docs, min_exponent=2)
