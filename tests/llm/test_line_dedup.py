import random

import duckdb
import pytest
from llm_brute import EDGES, frame, save, sha, spaced_words

from flowspark.llm import catalog, line_dedup


def brute(rows, min_lines=2, long_words=20):
    """(n_lines, n_removed, n_spans, kept text) by (id, text); rows with the same id and text are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0]))
    filled = {d: [(k, x) for k, x in enumerate((d[1] or "").split("\n")) if spaced_words(x)] for d in docs}
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        lines = [x for _, x in filled[d]]
        for p in range(len(lines)):
            for n in {min_lines, 1}:
                run = tuple(lines[p: p + n])
                if len(run) < n or (n == 1 < min_lines and len(spaced_words(run[0])) < long_words):
                    continue
                if (n, run) in seen:
                    gone[d] |= set(range(p, p + n))
                seen.add((n, run))
    out = {}
    for d in docs:
        cut = {filled[d][p][0] for p in gone[d]}
        kept = None if d[1] is None else "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in cut)
        spans = sum(p - 1 not in gone[d] for p in gone[d])
        out[d] = (0 if d[1] is None else d[1].count("\n") + 1, len(cut), spans, kept)
    return out


def rows_of(seed, docs, vocabulary):
    rng = random.Random(seed)
    lines = [f"line {k}" if k % 3 else " ".join(f"w{k}-{j}" for j in range(22)) for k in range(vocabulary)] + ["", "  "]
    return [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for k in range(docs)]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_equals_brute_force(spark, min_lines):
    rows = EDGES + [(100 + d, t) for d, t in rows_of(min_lines, 60, 5 if min_lines > 2 else 12)]
    got = line_dedup.dedup_lines(frame(spark, rows), min_lines).collect()
    wanted = brute(rows, min_lines)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.n_spans, r.kept_text) == wanted[(r.doc_id, r.text)]


def test_a_run_in_every_document_over_many_partitions(spark):
    shared = "alpha beta\ngamma delta\nepsilon"
    rows = [(k, f"own {k}\n{shared}\nend {k}") for k in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0].n_removed == 0
    assert all(got[k].kept_text == f"own {k}\nend {k}" and got[k].n_spans == 1 for k in range(1, 400))


def test_query_equals_sql(spark, tmp_path):
    rows = rows_of(7, 80, 9) + [(200, None), (201, ""), (202, "\n\n")]
    folder = save(spark, tmp_path / "t", rows)
    got = {tuple(r) for r in catalog.op3_line_dedup(spark, folder).collect()}
    wanted = brute(rows)
    assert got == {(d, *wanted[(d, t)][:3], sha((wanted[(d, t)][3] or "").encode())) for d, t in rows}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = db.execute(catalog.SQL["op3_line_dedup"])
    assert [d[0] for d in cursor.description] == ["doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256"]
    assert set(cursor.fetchall()) == got


def test_no_rows_and_clashing_columns(spark):
    docs = frame(spark, EDGES)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
    clash = docs.selectExpr("*", "1 AS pos", "2 AS lines", "'x' AS n_lines", "4 AS row_key")
    rows = line_dedup.dedup_lines(clash).collect()
    assert {(r.pos, r["lines"], r.row_key) for r in rows} == {(1, 2, 4)} and all(isinstance(r.n_lines, int) for r in rows)
