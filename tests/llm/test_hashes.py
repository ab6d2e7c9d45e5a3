import numpy as np
import pytest
from llm_brute import frame, near_components, quality_base

from flowspark.llm import language, line_dedup, near_dup, quality, textops
from flowspark.llm.components import connected_components


def mirrored(bits):
    """A Thue-Morse word over two letters and its complement: polynomials modulo 2^64 are bound to give them one value."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 12, 13])
def test_span_ids_tell_mirrored_words_apart(bits):
    words = mirrored(bits)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.array([0, 1 << bits])
    weak = textops.span_hashes(data, starts, starts + (1 << bits))
    assert weak[0] == weak[1]
    first, second = textops.span_ids(data, starts, starts + (1 << bits))
    assert first[0] != first[1] and second[0] != second[1]


def test_prime_hashes_equal_plain_arithmetic_anywhere():
    rng, p = np.random.default_rng(3), int(textops.PRIME)
    data = rng.integers(0, 256, 70_000).astype(np.uint8)
    starts = np.array([0, 5, 65_530, 69_990, 12])
    ends = np.array([3, 5, 65_600, 70_000, 66_000])
    for s, e, h in zip(starts.tolist(), ends.tolist(), textops.prime_hashes(data, starts, ends).tolist()):
        total = 0
        for k in range(e - 1, s - 1, -1):
            total = (total * textops.PRIME_BASE + int(textops.PRIME_CODES[data[k]])) % p
        assert h == total
    a, b = rng.integers(0, 1 << 61, (2, 500)).astype(np.uint64)
    assert [int(x) % p for x in textops.times_mod(a, b)] == [int(x) * int(y) % p for x, y in zip(a, b)]


@pytest.mark.parametrize("bits", [10, 13])
def test_operators_keep_mirrored_words_apart(spark, bits):
    one, other = mirrored(bits)
    rows = [(1, f"{one}\n{other}"), (2, f"{other}\n{one}"), (3, one), (4, other)]
    for r in quality.rate(frame(spark, rows), None).collect():
        assert r.n_dup_lines == quality_base(r.text)[3] == 0
    triples = [(7, " ".join([one, "x", "y", other, "x", "y"]))]
    assert quality.rate(frame(spark, triples), None).first().n_repeat_words == quality_base(triples[0][1])[4] == 0
    assert {r.n_removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {0}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_components(frame(spark, rows), 0.85).collect()}
    assert got == near_components(rows)


def test_an_ascending_chain_takes_few_steps(spark, monkeypatch):
    from flowspark.llm import components

    steps, kept = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: steps.append(name) or kept(df, name))
    edges = spark.createDataFrame([(k, k + 1) for k in range(2000)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(k, 0) for k in range(2001)}
    assert len(steps) <= 15


def test_segments_scored_in_blocks_keep_their_last_grams(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = pa.array(["".join(rng.choice(list("abcdé "), rng.integers(0, 9000))) for _ in range(12)] + ["", None])
    model = language.Model(["a", "b"], rng.normal(size=(1 << language.BITS, 2)).astype(np.float32))
    whole = model.scores(texts)
    for size in (1, 3, 7):
        monkeypatch.setattr(language, "SCORED_SEGMENTS", size)
        assert model.scores(texts) == pytest.approx(whole, rel=1e-4, abs=1e-4)
