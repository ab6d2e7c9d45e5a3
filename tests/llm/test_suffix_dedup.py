import random

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import EDGES, frame, removed_bytes, save, sha

from flowspark.llm import catalog, suffix_dedup
from flowspark.llm.common import utf8


def wanted(rows, size=200):
    out = []
    for (doc, _), data, mask in zip(rows, *removed_bytes([t for _, t in rows], size)):
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out.append((doc, len(data), sum(mask), spans, sha(bytes(x for x, m in zip(data, mask) if not m))))
    return sorted(out, key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(30, 120))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 80)))]
        for _ in range(rng.randrange(0, 3)):
            passage = rng.choice(passages)
            a = rng.randrange(0, len(passage) // 2)
            parts += [passage[a: a + rng.randrange(100, 500)], " ".join(word() for _ in range(rng.randrange(0, 30)))]
        out.append(" ".join(parts))
    return list(enumerate(out + [out[3], out[4] + "!", "z" * 700, "ab" * 300, out[5] * 2]))


@pytest.mark.parametrize("crowded", [4000, 3])
def test_equals_brute_force(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rows = texts(crowded) + [(1000 + (d or 0), t) for d, t in EDGES]
    folder = save(spark, tmp_path / "t", rows)
    assert sorted((tuple(r) for r in catalog.op4_suffix_dedup(spark, folder).collect()), key=str) == wanted(rows)


@pytest.mark.parametrize("size", [64, 136])
def test_other_sizes(spark, size):
    rows = texts(size, 25)
    got = suffix_dedup.remove_repeats(frame(spark, rows), size).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got), key=str) == wanted(rows, size)
    for r in got:
        raw = (r.text or "").encode()
        for a, n in reversed([(x["first"], x["count"]) for x in r.removed]):
            raw = raw[:a] + raw[a + n:]
        assert raw == bytes(r.kept)


@pytest.mark.parametrize("shard_bytes", [1, 300, 10**9])
def test_merged_order_is_the_sorted_order(shard_bytes):
    rng = random.Random(9)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    contexts = [base[rng.randrange(60):][: rng.randrange(40, 200)] for _ in range(40)]
    collection = suffix_dedup.Collection(contexts)
    merged, interval = collection.merge(5, shard_bytes)
    assert sorted(merged) == list(range(len(collection.symbols)))

    def key(j):
        out = []
        for _ in range(5):
            out.append(int(collection.symbols[j]))
            j = collection.follows[j]
        return tuple(out)

    keys = [key(j) for j in merged]
    assert keys == sorted(keys)
    assert all((interval[k] == interval[k - 1]) == (keys[k] == keys[k - 1]) for k in range(1, len(keys)))


def test_anchors_are_the_same_for_equal_strings():
    rng = random.Random(2)
    shared = "".join(rng.choice("xyz ") for _ in range(260))
    data, offsets = utf8(pa.array(["left" + shared, "", "another beginning " + shared + " end", "short"]))
    hashes, starts, counts, rows = suffix_dedup.anchors_of(data, offsets, 200)
    assert counts.sum() == np.maximum(0, np.diff(offsets) - 199).sum()
    at = {r: {int(s) + k - (4 if r == 0 else offsets[2] + 18): int(h) for h, s, n, q in zip(hashes, starts, counts, rows) if q == r
              for k in range(n)} for r in (0, 2)}
    assert all(at[0][k] == at[2][k] for k in range(61))


def test_no_rows_and_clashing_columns(spark):
    docs = frame(spark, EDGES)
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    clash = docs.selectExpr("*", "1 AS at", "'x' AS kept", "2 AS row_key", "3 AS anchor")
    rows = suffix_dedup.remove_repeats(clash).collect()
    assert len(rows) == len(EDGES) and {(r["at"], r.row_key, r.anchor) for r in rows} == {(1, 2, 3)}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, 100)


def test_part_of_a_task_without_a_repeated_string(spark, tmp_path, monkeypatch):
    """Where a task is solved in parts, one whose anchors repeat but none of their strings does must not change the type of runs."""
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 1)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = noise(150), noise(400)
    rows = [(k, noise(400) + short + noise(400) + long + noise(300)) for k in range(4)]
    folder = save(spark, tmp_path / "t", rows)
    assert sorted(tuple(r) for r in catalog.op4_suffix_dedup(spark, folder).collect()) == wanted(rows)
