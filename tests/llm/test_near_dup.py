import random

import pytest
from llm_brute import EDGES, frame, near_components, save

from flowspark.llm import catalog, near_dup
from flowspark.llm.components import connected_components


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def clusters(seed):
    """Copies of several texts with up to a few changed words, at similarities on both sides of the limits."""
    rng, rows = random.Random(seed), []
    for size in (2, 3, 40, 12):
        base = words(rng, 150)
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = "changed" + str(rng.randrange(10**6))
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    rows += [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(40)]
    rows += ["same short text"] * 5 + ["Same SHORT\ttext"] + ["a b c d e f"] * 3 + ["a b c d e"]
    rng.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("limit", [80, 85])
def test_components_equal_brute_force(spark, limit):
    rows = clusters(limit)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_components(frame(spark, rows), limit / 100).collect()}
    assert got == near_components(rows, limit)


def test_query_with_null_and_repeated_rows(spark, tmp_path):
    folder = save(spark, tmp_path / "t", EDGES)
    rows = catalog.op9_near_duplicates(spark, folder).collect()
    assert len(rows) == len(EDGES)
    wanted = near_components([(d, t) for d, t in EDGES if d is not None])
    for r in rows:
        if r.doc_id is None:
            assert r.n_shingles == 1 and r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_partitions_hand_their_edges_on(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" end{k}") for k in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = near_dup.near_components(frame(spark, rows), 0.85).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_drop_near_duplicates(spark):
    docs = frame(spark, [(2, "one two three four five six"), (1, "ONE two three four five six"), (3, None), (4, ""), (None, "one two three four five six"),
                         (5, "other words")]).selectExpr("*", "1 AS row_key", "2 AS node")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert near_dup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_connected_components(spark):
    rng = random.Random(4)
    chain = list(range(1, 200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (7, 8), (8, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in chain}, **{k: 1000 for k in range(1000, 1100)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
