import random

import pytest
from llm_brute import rebuilt_conversations, trie_nodes

from flowspark.llm import catalog, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(seed, count, letters=3, most=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(count * 2), count):
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["é" * k for k in range(letters)] + [None])) for t in range(rng.randrange(1, most))]
    return rows


SPECIAL = [(1000, None, "user", "first"), (1000, 5, "bot", "later"), (1001, 0, None, None), (1003, 3, "user", ""), (None, 1, "user", "nobody"),
           (1010, 1, "user", "x"), (1011, 1, "user", "x"), (1012, 1, "user", "x")]


def check(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = catalog.op13_prefix_trie(spark, str(folder))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    wanted = trie_nodes(rebuilt_conversations(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_query_equals_brute_force(spark, tmp_path, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        check(spark, tmp_path, rows_of(partitions, 150) + SPECIAL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_first_turns_and_equal_conversations(spark, tmp_path):
    rows = [(c, t, "user", f"common {t}") for c in range(300) for t in range(9)]
    rows += [(1000 + c, t, "user", "hello" if t < 10 else f"own {c % 40} {t}") for c in range(200) for t in range(14)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        check(spark, tmp_path, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations_ties_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert catalog.op13_prefix_trie(spark, str(tmp_path)).collect() == []
    tied = spark.createDataFrame([(1, 1, "b", "y"), (1, 1, "a", "x"), (2, 1, "a", "x"), (2, 1, "b", "y")], SCHEMA)
    convs = prefix_trie.conversations(tied.selectExpr("*", "1 AS seq", "2 AS t", "3 AS depth"))
    assert len({str(r.seq) for r in convs.collect()}) == 1
    nodes, members = prefix_trie.trie(convs)
    assert sorted((r.depth, r.n_convs) for r in nodes.collect()) == [(0, 2), (1, 2), (2, 2)]
    ends = {r.seq_key for r in nodes.collect() if r.seq_key}
    assert {r.seq_key for r in members.collect()} == ends and members.count() == 2


def test_an_empty_conversation_ends_at_the_root(spark):
    convs = prefix_trie.conversations(spark.createDataFrame([(7, 1, "a", "x")], SCHEMA))
    empty = convs.selectExpr("8L AS conv_id", "slice(seq, 1, 0) AS seq")
    nodes, members = prefix_trie.trie(convs.union(empty))
    rows = sorted(nodes.collect(), key=lambda r: r.depth)
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_bytes) for r in rows] == [(0, 2, 1, 1, 0), (1, 1, 0, 1, 0)]
    assert rows[0].seq_key in {r.seq_key for r in members.where("conv_id = 8").collect()}
    only = prefix_trie.trie(empty)[0].collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves) for r in only] == [(0, 1, 0, 1)]
