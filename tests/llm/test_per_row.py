from collections import Counter

import public_tokenizers
import pytest
from llm_brute import EDGES, bpe_ids, crc, frame, overlap, save, sha

from pyspark.sql import functions as F

from flowspark.llm import bpe, catalog, decontaminate, sharding

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ITEMS = [(1, "a b c d e f g h i j k l m n o"), (2, "Fox\njumps OVER the"), (3, None), (4, "..."), (4, "lazy dog"), (5, "lazy, dog!")]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_bpe_equals_tiktoken(spark, tmp_path):
    folder = save(spark, tmp_path / "t", EDGES)
    got = ordered(catalog.op2_byte_bpe(spark, folder).collect())
    ids = bpe_ids([t for _, t in EDGES])
    wanted = ordered((d, len(i), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for (d, t), i in zip(EDGES, ids))
    assert got == wanted


def test_bpe_long_pieces_by_matrix_and_heap():
    encoder = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in ("ab" * 60, "mississippi" * 20, "Donaudampfschifffahrt" * 9, "é" * 100, "aab" * 70, "                    "):
        raw = text.encode()[:250]
        assert encoder.merge_matrix([raw], 256)[0].tolist() == encoder.merge_long(raw).tolist()


def test_decoding_gives_the_bytes_back(spark):
    coded = bpe.encode(frame(spark, EDGES), PATH, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(coded, PATH).collect())
    none = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "n int, ids array<int>"), PATH)
    assert {bytes(r.decoded) for r in none.collect()} == {b""}


def test_bpe_on_no_rows_and_clashing_columns(spark):
    empty = frame(spark, EDGES[:1]).limit(0)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).collect() == []
    clash = frame(spark, [(1, "hello world")]).selectExpr("*", "'x' AS ids", "1 AS slot")
    row = bpe.encode(clash, PATH, public_tokenizers.PATTERN).first()
    assert row.slot == 1 and list(row.ids) == bpe_ids(["hello world"])[0]


@pytest.mark.parametrize("block", [100_000, 2])
def test_overlap_equals_brute_force(spark, block):
    rows = EDGES + [(20, "so a b c d e f g h i j k l m n. Lazy-DOG"), (21, "nothing here"), (22, "lazy dog")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = decontaminate.find_overlap(frame(spark, rows), items, block_windows=block)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"]).encode()),
            r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in marked.collect()]
    assert ordered(got) == ordered(overlap(rows, ITEMS))


def test_overlap_query(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    folder = save(spark, tmp_path / "t", EDGES, benchmark=items)
    assert ordered(catalog.op8_decontaminate(spark, folder).collect()) == ordered(overlap(EDGES, ITEMS))


def test_overlap_without_items_or_documents(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_overlap(frame(spark, EDGES), items).collect()} == {0}
    assert decontaminate.find_overlap(frame(spark, EDGES).limit(0), items).collect() == []


def test_spans_and_documents_are_removed(spark):
    items = spark.createDataFrame([(1, "lazy dog")], "item_id long, text string")
    docs = frame(spark, [(1, "The Lazy dog sleeps"), (2, "no match"), (3, None)]).selectExpr("*", "7 AS n_hit")
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()) == [2, 3]
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns
    cut = {r.doc_id: r.clean_text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut == {1: "The sleeps", 2: "no match", 3: None}


def test_shards_have_equal_counts(spark, tmp_path):
    rows = EDGES + [(100 + k, "same text") for k in range(500)] + [(1000 + k, f"text {k}", "de", f"s{k % 7}") for k in range(333)]
    folder = save(spark, tmp_path / "t", rows)
    got = catalog.op10_hilbert_shards(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, crc(r[1])) for r in rows)
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_are_runs_of_the_curve(spark):
    rows = [(k, "x" * (k % 900), ["en", "de", None][k % 3], f"s{k % 11}") for k in range(1500)] + [(7, "same", "en", "hot")] * 600 + EDGES
    clash = frame(spark, rows).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS salt", "4 AS rank", "5 AS size")
    got = sharding.assign_shards(clash, 40).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    curve = [r.curve for r in order]
    assert curve == sorted(curve) and len(set(curve)) > 50  # rows lie along the curve, so each shard is a run of it
    where = {}
    for r in got:
        where.setdefault(r.curve, set()).add(r.shard)
    assert all(max(s) - min(s) + 1 == len(s) for s in where.values())
    cells = frame(spark, rows)
    index = {(r.c[0], r.c[1], r.c[2], r.c[3]): r.h for r in cells.select(
        F.array(*sharding.grid(cells, 3)).alias("c"), sharding.hilbert_index(sharding.grid(cells, 3), 3).alias("h")).distinct().collect()}
    assert set(index.values()) == set(curve) and len(set(index.values())) == len(index)


def test_few_or_no_rows_to_shard(spark):
    assert sharding.assign_shards(frame(spark, EDGES).limit(0)).collect() == []
    assert len({r.shard for r in sharding.assign_shards(frame(spark, EDGES[:3])).collect()}) == 3


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_curve_visits_neighbours(spark, dims):
    side = 8 if dims < 4 else 4
    cells = spark.range(side**dims)
    names = [f"(id div {side**k} % {side})" for k in range(dims)]
    cells = cells.selectExpr(*[f"cast({n} as int) AS c{k}" for k, n in enumerate(names)])
    bits = side.bit_length() - 1
    path = sorted(cells.select("*", sharding.hilbert_index([cells[c] for c in cells.columns], bits).alias("h")).collect(),
                  key=lambda r: r.h)
    assert [r.h for r in path] == list(range(side**dims))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(path, path[1:]))


def test_shards_are_written(spark, tmp_path):
    sharding.write_shards(frame(spark, EDGES), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= len(EDGES)
