"""Quality rules by line labelling: a linear-chain CRF marks each line content or boilerplate.

Every line has real-valued features (lengths, shares of character classes, repetition); the chain's weights and its
transitions are fitted by maximum likelihood on lines of labelled documents: those of good documents count as content
unless they repeat an earlier line of the text, all others as boilerplate. Viterbi decoding marks the lines of each
whole text, for all texts of a slice at once, and a document is kept if enough of its words lie in content lines and the
base rules don't fail it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import text_of, utf8, with_columns
from flowspark.llm.textops import SPACED, covered, lines_of, per_text, span_ids, spans_where, window_hashes

FIT_DOCS = 1500
FIT_LINES = 30_000
MIN_SHARE = 0.5
MOVE_PENALTY = 0.2
FIELDS = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                               "n_content_words")],
    T.StructField("content_share", T.DoubleType()), T.StructField("content_lines", T.ArrayType(T.BooleanType())),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
])


def byte_class(characters: bytes) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[list(characters)] = True
    return marks


SYMBOLS = byte_class(b"#*$%&|<>")
CLASSES = [SYMBOLS, byte_class(b"|"), byte_class(bytes(range(0x41, 0x5B))), byte_class(bytes(range(0x30, 0x3A))), byte_class(b".,;:"),
           byte_class(b"!?"), byte_class(b"/\\@=_{}[]()\"'+-")]
DUPLICATE = 1 + len(CLASSES) + 3  # the feature's column


class Lines:
    """Words, lines and repetition of a slice of texts, as counts."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        n = len(offsets) - 1
        starts, ends, rows = spans_where(SPACED[data], offsets)
        in_words = SPACED[data] & ((data & 0xC0) != 0x80)
        at_byte = np.r_[0, np.cumsum(in_words)]
        hashes = span_ids(data, starts, ends)[0]
        triples, at = window_hashes(hashes, rows, 3)
        repeated = covered(at[_twice(triples, rows[at])], 3, len(starts))
        self.first, self.last, self.row = lines_of(data, offsets)
        line_of_word = np.searchsorted(self.first, starts, "right") - 1
        # an empty line starts where the next one's text may: take the last line that begins there
        lines = len(self.first)
        self.words = np.bincount(line_of_word, minlength=lines)
        line_hashes = span_ids(data, self.first, self.last)[0]
        filled = np.flatnonzero(self.words > 0)
        self.duplicate = np.zeros(lines, bool)
        self.duplicate[filled[_later(line_hashes[filled], self.row[filled])]] = True
        self.n_words = per_text(np.ones(len(starts)), rows, n)
        ends_at = at_byte[offsets]
        self.word_chars = ends_at[1:] - ends_at[:-1]
        symbols = np.r_[0, np.cumsum(SYMBOLS[data])]
        self.n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
        self.n_dup_lines = per_text(self.duplicate, self.row, n)
        self.n_repeat_words = per_text(repeated, rows, n)
        self.base_failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)
        self.features = self._features(data, at_byte, np.bincount(line_of_word, weights=repeated, minlength=lines))

    def _features(self, data, at_byte, repeated) -> np.ndarray:
        characters = np.maximum(1, at_byte[self.last] - at_byte[self.first])
        columns = [np.ones(len(self.first))]
        for marks in CLASSES:
            sums = np.r_[0, np.cumsum(marks[data])]
            columns.append(np.minimum(1, 4 * (sums[self.last] - sums[self.first]) / characters))
        columns.append(np.log1p(self.words) / 4)
        columns.append(np.minimum(2, characters / np.maximum(1, self.words) / 8))
        columns.append(repeated / np.maximum(1, self.words))
        columns.append(self.duplicate)
        columns.append(self.words == 0)
        return np.stack(columns, 1).astype(np.float64)


def _order(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    return order, (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])


def _later(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which items equal an earlier one of their text."""
    order, same = _order(hashes, rows)
    found = np.zeros(len(hashes), bool)
    found[order[1:][same]] = True
    return found


def _twice(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which items equal any other one of their text."""
    order, same = _order(hashes, rows)
    found = np.zeros(len(hashes), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def padded(features: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of lines by (step, text), longest text first, and how many texts reach each step."""
    counts = np.bincount(rows, minlength=n)
    order = np.argsort(-counts, kind="stable")
    reach = np.array([np.count_nonzero(counts > k) for k in range(counts.max(initial=0))])
    return order, reach


class Chain:
    """Linear-chain CRF with two states (0 boilerplate, 1 content)."""

    def __init__(self, n_features: int):
        self.weights = np.zeros((n_features, 2))
        self.moves = np.zeros((2, 2))

    def fit(self, features: np.ndarray, labels: np.ndarray, rows: np.ndarray, n: int, steps: int = 200) -> Chain:
        """Maximum likelihood with a small quadratic penalty, by Adam on the whole sample."""
        order, reach = padded(features, rows, n)
        starts = np.searchsorted(rows, np.arange(n))
        onehot = np.eye(2)[labels]
        flat = [np.zeros(self.weights.size + 4), np.zeros(self.weights.size + 4)]
        for step in range(1, steps + 1):
            potentials = features @ self.weights
            alphas, expected, pairs = [], np.zeros_like(potentials), np.zeros((2, 2))
            for k, m in enumerate(reach):
                at = starts[order[:m]] + k
                alphas.append(potentials[at] if k == 0 else potentials[at] + np.logaddexp.reduce(
                    alphas[-1][:m, :, None] + self.moves, axis=1))
            beta = np.zeros((0, 2))
            partition = np.zeros(n)
            for k in range(len(reach) - 1, -1, -1):
                m = reach[k]
                at = starts[order[:m]] + k
                now = np.zeros((m, 2))
                if len(beta):
                    later = potentials[at[: len(beta)] + 1] + beta
                    now[: len(beta)] = np.logaddexp.reduce(self.moves[None] + later[:, None, :], axis=2)
                if k == 0:
                    partition[order[:m]] = np.logaddexp.reduce(alphas[0][:m] + now, axis=1)
                alphas[k] = (alphas[k], now)
                beta = now
            for k, (alpha, now) in enumerate(alphas):
                m = len(alpha)
                texts = order[:m]
                at = starts[texts] + k
                expected[at] = np.exp(alpha + now - partition[texts][:, None])
                if k + 1 < len(reach):
                    q = reach[k + 1]
                    joint = np.exp(alpha[:q, :, None] + self.moves + (potentials[at[:q] + 1] + alphas[k + 1][1])[:, None, :]
                                   - partition[texts[:q]][:, None, None])
                    seen = onehot[at[:q]][:, :, None] * onehot[at[:q] + 1][:, None, :]
                    pairs += (seen - joint).sum(axis=0)
            penalty = np.r_[1e-3 * self.weights.ravel(), MOVE_PENALTY * self.moves.ravel()]
            slope = np.r_[(features.T @ (onehot - expected)).ravel(), pairs.ravel()] / len(rows) - penalty
            flat[0] = 0.9 * flat[0] + 0.1 * slope
            flat[1] = 0.99 * flat[1] + 0.01 * slope**2
            change = 0.1 * (flat[0] / (1 - 0.9**step)) / (np.sqrt(flat[1] / (1 - 0.99**step)) + 1e-8)
            self.weights += change[:-4].reshape(self.weights.shape)
            self.moves += change[-4:].reshape(2, 2)
        return self

    def decode(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Viterbi: the likeliest states of the lines of each text; ties go to content."""
        order, reach = padded(features, rows, n)
        starts = np.searchsorted(rows, np.arange(n))
        potentials = features @ self.weights
        best, back = None, []
        finals = np.zeros((n, 2))
        for k, m in enumerate(reach):
            at = starts[order[:m]] + k
            if k == 0:
                best = potentials[at]
            else:
                options = best[:m, :, None] + self.moves
                choice = (options[:, 1] >= options[:, 0]).astype(np.int8)
                back.append(choice)
                best = np.maximum(options[:, 0], options[:, 1]) + potentials[at]
            finals[order[:m]] = best
        states = np.ones(len(features), np.int8)
        last = (finals[:, 1] >= finals[:, 0]).astype(np.int8)
        for k in range(len(reach) - 1, -1, -1):
            m = reach[k]
            at = starts[order[:m]] + k
            if k + 1 < len(reach):
                q = reach[k + 1]
                last[order[:q]] = back[k][np.arange(q), last[order[:q]]]
            states[at] = last[order[:m]]
        return states == 1


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Chain | None:
    """Learn from documents with a quality label: at most about `fit_docs` of them, chosen by a hash of the id, and of
    their lines the first FIT_LINES in that order. Without lines of both kinds there is no chain (None)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").dropDuplicates(["doc_id"])
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1, fit_docs / max(1, total)) * (1 << 30)) + 1)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def compute(batch):
        found = Lines(text_of(batch))
        bounds = np.searchsorted(found.row, np.arange(batch.num_rows + 1))
        values = [] if not len(found.row) else [
            [] if failed else found.features[a:b].ravel().tolist()
            for a, b, failed in zip(bounds[:-1], bounds[1:], found.n_words == 0)]
        return [pa.array(values, pa.list_(pa.float64()))]

    fields = T.StructType([T.StructField("line_features", T.ArrayType(T.DoubleType()))])
    lines = with_columns(texts, fields, compute).where(F.size("line_features") > 0).dropDuplicates(["doc_id"])
    sample = lines.select("doc_id", "quality", "line_features").orderBy(F.xxhash64("doc_id")).collect()  # about fit_docs rows
    width = len(CLASSES) + 6
    features, states, rows, used = [], [], [], 0
    for row in sample:
        block = np.array(row["line_features"]).reshape(-1, width)
        if used + len(block) > FIT_LINES:
            continue
        features.append(block)
        states.append(((row["quality"] > 0) & (block[:, DUPLICATE] == 0)).astype(int))
        rows.append(np.full(len(block), len(rows)))
        used += len(block)
    if not features or len(np.unique(np.concatenate(states))) < 2:
        return None
    return Chain(width).fit(np.concatenate(features), np.concatenate(states), np.concatenate(rows), len(rows))


def rate(docs: DataFrame, chain: Chain | None, min_share: float = MIN_SHARE) -> DataFrame:
    """Add the base counts, content_lines (one mark per line of the text), n_content_words, content_share, base_failed
    and kept to every document.

    Needs text; all rows and other columns are kept, columns of these names replaced. Null and wordless texts have no
    words, share 0 and fail the base rules. Without a chain every line is content. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def compute(batch):
        found, n = Lines(text_of(batch)), batch.num_rows
        states = shared.value.decode(found.features, found.row, n) if shared.value else np.ones(len(found.row), bool)
        content = per_text(found.words * states, found.row, n)
        share = content / np.maximum(1, found.n_words)
        marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(found.row, np.arange(n + 1)).astype(np.int32)),
                                         pa.array(states))
        return [*[pa.array(x.astype(np.int64)) for x in (found.n_words, found.word_chars, found.n_symbols,
                                                         found.n_dup_lines, found.n_repeat_words, content)],
                pa.array(share), marks, pa.array(found.base_failed), pa.array(~found.base_failed & (share >= min_share))]

    return with_columns(docs, FIELDS, compute)
