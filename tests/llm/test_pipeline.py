import random

import pytest
from llm_brute import EDGES, bpe_ids, frame, near_components, overlap, save, sha
from test_line_dedup import brute as line_brute

import __spark_entry__ as entry
import corpus_pipeline

ENGLISH = "the cat sat on the mat while rain fell over the quiet old town and people walked home slowly".split()
GERMAN = "der hund lief schnell durch den wald und die kinder spielten noch lange im garten hinter dem haus".split()


def documents():
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words, lang = (ENGLISH, "en") if k % 2 else (GERMAN, "de")
        lines = [" ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(4, 30)))
                 for _ in range(rng.randrange(2, 8))]
        rows.append((k, "\n".join(lines), lang))
    shared = rows[3][1].split("\n")
    rows += [(100, rows[1][1], "en"), (101, rows[5][1] + " extra", "en"), (102, "new line here\n" + "\n".join(shared[:2]) + "\nthe end", "en"),
             (103, "the benchmark asks what the cat said to the old dog about rain", "en"),
             (104, "a long text " + " ".join(rng.choice(ENGLISH) for _ in range(400)) + " the cat said to the old dog about rain", "en"),
             (105, "123 456", "en"), (106, None, "en"), (107, "", None), (108, "---", "de"), (None, "der hund ohne nummer lief heim", "de")]
    return rows


ITEMS = [(1, "What the cat said to the old dog about rain"), (2, None)]


def expected(kept, items):
    """Stages two to five by brute force over the rows that the first one kept."""
    cut = {d: line_brute(kept)[d] for d in kept}
    rows = [(d, x[3] if x[1] else t) for (d, t), x in cut.items() if not x[1] or x[3].split()]
    ids = {d: c for d, (_, c) in near_components([r for r in rows if r[0] is not None], 80).items()}
    rows = [(d, t) for d, t in rows if d is None or ids[d] == d]
    dirty = {d for d, *_, bad in overlap(rows, items) if bad}
    rows = [r for r in rows if r[0] not in dirty]
    return {(d, sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for (d, t), i in zip(rows, bpe_ids([t for _, t in rows]))}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents()
    folder = save(spark, tmp_path / "t", rows, benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    kept = [(d, t) for d, t, _ in rows if d not in (105, 106, 107, 108)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs, folder)
    assert {(r.doc_id, r.text) for r in first.collect()} == set(kept) and first.columns == docs.columns
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["pipeline"](spark, folder).collect()}
    assert got == expected(kept, ITEMS)
    ids = {d for d, *_ in got}
    assert {100, 103} & ids == set() and {102, 104, None} <= ids


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_bear_edge_cases(spark, tmp_path, k):
    folder = save(spark, tmp_path / "t", EDGES, benchmark=spark.createDataFrame([], "item_id long, text string"))
    extra = ["1 AS n_words", "'x' AS lang_pred", "2 AS _n", "3 AS row_key", "4 AS n_lines", "5 AS ids", "6 AS kept_text"]
    docs = frame(spark, EDGES).selectExpr("*", *extra)
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    rows = out.collect()
    assert out.columns == docs.columns
    assert all((r.n_words, r.lang_pred, r._n, r.row_key, r.n_lines, r.ids, r.kept_text) == (1, "x", 2, 3, 4, 5, 6) for r in rows)
    texts = [(r.doc_id, r.text) for r in rows]
    assert set(texts) <= set(EDGES)
    if k == 0:
        assert {d for d, _ in EDGES} - {d for d, _ in texts} == {1, 2, 3}
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), folder).collect() == []


def test_changed_texts_have_their_length(spark, tmp_path):
    docs = frame(spark, [(1, "a b\nc d\ne f"), (2, "own\na b\nc d\nmore"), (3, "a b\nc d")])
    rows = {r.doc_id: r for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert set(rows) == {1, 2} and rows[2].text == "own\nmore" and rows[2].n_chars == 8 and rows[1].n_chars == 11


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near duplicates", "decontamination", "encoding"]
    names = entry.queries()
    assert all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
