"""Toxicity by a subsequence string kernel: a support vector machine over Nystroem landmarks.

The unit is a window of WINDOW starting places that begins at a word (long words get several). The gap-weighted
subsequence kernel counts the sequences of 3 and 4 bytes that two windows share, gaps allowed: one that spans s bytes
weighs DECAY^(s - length). So an insult with letters pulled apart or characters put between still shares most of its
sequences with the plain one. The kernel is computed through its (hashed) feature map; Nystroem features come from
landmark windows, a linear SVM with squared hinge loss is trained on them, and its dual weights are folded over the
landmarks to one weight per sequence, which makes scoring a sum over a text's bytes.

Labels mark documents, not sentences: training starts from sequences common in toxic documents and then alternates
between fitting the machine and taking each toxic document's highest windows as its toxic sentences; the last rounds
add copies of these with characters put in.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import text_of, utf8, with_columns
from flowspark.llm.textops import SPACED, ranges, spans_where

BITS = 16
SPAN = 5
DECAY = 0.7
WINDOW = 12
STRIDE = 8
SHAPES = [c for n in (2, 3) for c in combinations(range(1, SPAN), n)]
SHAPE_WEIGHTS = np.array([DECAY ** (c[-1] - len(c)) for c in SHAPES], np.float32)
MULTIPLIERS = [np.uint32(m) for m in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
LANDMARKS = 400
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 800, 1200, 20_000
ROUNDS = 4
COPIES = 3
SOFTNESS = 10.0
FIELDS = T.StructType([T.StructField("toxicity", T.DoubleType()), T.StructField("worst_at", T.LongType())])

BLANK = np.arange(256, dtype=np.uint8)
BLANK[~SPACED] = 32


class Windows:
    """Sequences and windows of a slice of texts."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(pc.utf8_lower(column))
        self.offsets, self.n = offsets, len(offsets) - 1
        # each text between blanks, so that no window reaches the next one
        sizes = np.diff(offsets) + SPAN + WINDOW
        self.places = np.cumsum(sizes) - sizes
        self.data = np.full(int(sizes.sum()) + SPAN + WINDOW, 32, np.uint8)
        self.data[ranges(self.places + 1, np.diff(offsets))] = BLANK[data]
        bounds = np.r_[self.places, sizes.sum()]
        starts, ends, _ = spans_where(self.data[: bounds[-1]] != 32, bounds)
        pieces = np.maximum(1, (ends - starts) // STRIDE)
        self.starts = np.repeat(starts, pieces) - 1 + STRIDE * (ranges(np.zeros(len(pieces), np.int64), pieces))
        self.rows = np.searchsorted(bounds, self.starts + 1, "right") - 1

    def sequences(self):
        """For each shape of sequence, the hashed sequence that starts at every byte."""
        n = len(self.data) - SPAN + 1
        codes = self.data.astype(np.uint32)
        shifted = [codes[k: k + n] for k in range(SPAN)]
        scaled = [[None] + [s * m for s in shifted[1:]] for m in MULTIPLIERS[1:]]
        head = shifted[0] * MULTIPLIERS[0]
        for shape in SHAPES:
            h = head + np.uint32(len(shape))
            for k, place in enumerate(shape):
                h = h + scaled[k][place]
            h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of each window's sequences."""
        total = None
        for slots, weight in zip(self.sequences(), SHAPE_WEIGHTS):
            part = weights[slots] * weight
            total = part if total is None else total + part
        if not len(self.starts):
            return np.zeros(0)
        sums = np.r_[0.0, np.cumsum(total, dtype=np.float64)]
        return sums[np.minimum(self.starts + WINDOW, len(sums) - 1)] - sums[self.starts]

    def slots(self, chosen: np.ndarray) -> np.ndarray:
        """Hashed sequences of some windows, one row each."""
        at = np.minimum(self.starts[chosen][:, None] + np.arange(WINDOW), len(self.data) - SPAN)
        return np.concatenate([slots[at] for slots in self.sequences()], axis=1)

    def presence(self) -> np.ndarray:
        """Which sequences each text holds."""
        held = np.zeros((self.n, 1 << BITS), bool)
        rows = np.repeat(np.arange(self.n), np.diff(np.r_[self.places, len(self.data) - SPAN + 1]))
        for slots in self.sequences():
            held[rows, slots[: len(rows)]] = True
        return held

    def highest(self, scores: np.ndarray, count: int) -> np.ndarray:
        """Each text's `count` highest windows."""
        order = np.lexsort((-scores, self.rows))
        firsts = np.searchsorted(self.rows[order], np.arange(self.n))
        place = np.arange(len(order)) - firsts[self.rows[order]]
        return order[place < count]

    def document_features(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score and log count of windows by text, and the highest window."""
        out = np.zeros((self.n, 2))
        top = np.full(self.n, -1)
        best = self.highest(scores, 1)
        out[self.rows[best], 0] = scores[best]
        top[self.rows[best]] = best
        out[:, 1] = np.log1p(np.bincount(self.rows, minlength=self.n))
        return out, top


def disguised(windows: Windows, chosen: np.ndarray, rng: np.random.Generator) -> list[str]:
    """The beginnings of some windows with one character put in, or the letters of their first word pulled apart."""
    out = []
    for start in windows.starts[chosen] + 1:
        text = windows.data[start: start + WINDOW + SPAN].tobytes().decode(errors="ignore")
        word, blank, rest = text.partition(" ")
        mark = "..--__**  xaeiou"[rng.integers(16)]
        if rng.integers(2):
            at = rng.integers(1, max(2, len(word)))
            out.append(word[:at] + mark + word[at:] + blank + rest)
        else:
            out.append("..--_* "[rng.integers(7)].join(word) + blank + rest)
    return out


REPEATED_WEIGHTS = np.repeat(SHAPE_WEIGHTS, WINDOW)


def feature_rows(slots: np.ndarray) -> np.ndarray:
    """Explicit feature vectors of windows (dense; for landmarks only)."""
    out = np.zeros((len(slots), 1 << BITS), np.float32)
    np.add.at(out, (np.arange(len(slots))[:, None], slots), REPEATED_WEIGHTS)
    return out


def kernel(slots: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel of windows with landmarks given as features by window (transposed)."""
    out = np.empty((len(slots), landmarks.shape[1]), np.float32)
    for a in range(0, len(slots), 64):
        out[a: a + 64] = np.einsum("nfm,f->nm", landmarks[slots[a: a + 64]], REPEATED_WEIGHTS, optimize=True)
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, softness: float) -> np.ndarray:
    """Linear SVM with squared hinge loss and a bias (last column of z), by Newton steps; classes weigh the same."""
    beta = np.zeros(z.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * softness
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(25):
        active = y * (z @ beta) < 1
        za = z[active] * weight[active][:, None]
        new = np.linalg.solve(penalty + za.T @ z[active], za.T @ y[active])
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = new
    return beta


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-2 * theta
        theta = theta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(theta)), g)
    return theta


class Model:
    """A weight per hashed sequence, and the curve from a text's highest window to a probability."""

    def __init__(self, weights: np.ndarray, center: np.ndarray, scale: np.ndarray, theta: np.ndarray):
        self.weights, self.center, self.scale, self.theta = weights, center, scale, theta

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[(features - self.center) / self.scale, np.ones(len(features))]
        return 1 / (1 + np.exp(-np.clip(x @ self.theta, -30, 30)))


def fit_texts(texts: list[str], toxic: np.ndarray, base_rate: float, landmarks: int = LANDMARKS) -> Model | None:
    """Train on documents in a fixed random order; every fourth one only fits the curve."""
    toxic = np.asarray(toxic, bool)
    held = np.arange(len(texts)) % 4 == 3
    groups = [[t for t, x, h in zip(texts, toxic, held) if x == want and not h] for want in (True, False)]
    if not all(groups):
        return None
    bad, good = (Windows(pa.array(g, pa.string())) for g in groups)
    if not len(bad.starts) or not len(good.starts):
        return None
    seen = [sum((Windows(pa.array(g[a: a + 100], pa.string())).presence().sum(axis=0) for a in range(0, len(g), 100)))
            for g in groups]
    weights = (np.log((seen[0] + 0.5) / (bad.n + 1)) - np.log((seen[1] + 0.5) / (good.n + 1))).astype(np.float32)
    rng = np.random.default_rng(11)
    spread = rng.permutation(len(good.starts))[: 3 * good.n]
    extra: list[np.ndarray] = []
    for step in range(ROUNDS):
        positive = bad.highest(bad.scores(weights), 1 + (step < 2))
        extra.append(good.highest(good.scores(weights), 2))
        negative = np.unique(np.concatenate([spread, *extra]))
        slots = [bad.slots(positive), good.slots(negative)]
        y = [np.ones(len(positive)), -np.ones(len(negative))]
        if step >= ROUNDS // 2:  # the toxic windows are known well enough to be disguised, and as many clean ones
            ranks = bad.scores(weights)[positive]
            sure = positive[ranks >= np.median(ranks)]
            sure = np.repeat(sure, COPIES)
            for windows, some, sign in ((bad, sure, 1), (good, rng.choice(negative, min(len(negative), 2 * len(sure)), False), -1)):
                altered = Windows(pa.array(disguised(windows, some, rng), pa.string()))
                slots.append(altered.slots(np.flatnonzero(np.r_[True, altered.rows[1:] != altered.rows[:-1]])))
                y.append(np.full(len(slots[-1]), float(sign)))
        slots, y = np.concatenate(slots), np.concatenate(y)
        positive, negative = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
        half = landmarks // 2
        marks = np.r_[rng.permutation(positive)[:half], rng.permutation(negative)[:half]]
        phi = feature_rows(slots[marks])
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        kept = values > 1e-4 * values[-1]
        root = vectors[:, kept] / np.sqrt(values[kept])
        z = kernel(slots, np.ascontiguousarray(phi.T)) @ root
        size = np.sqrt(np.mean((z**2).sum(axis=1)))
        beta = fit_svm(np.c_[z / size, np.ones(len(z))], y, SOFTNESS)
        weights = (phi.T @ (root @ (beta[:-1] / size))).astype(np.float32)
    curve = Windows(pa.array([t for t, h in zip(texts, held) if h], pa.string()))
    labels = toxic[held]
    features, _ = curve.document_features(curve.scores(weights))
    if len(set(labels)) < 2:  # too few to hold any back
        both = Windows(pa.array(texts, pa.string()))
        features, labels = both.document_features(both.scores(weights))[0], toxic
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    share = labels.mean()
    weight = np.where(labels, base_rate / share, (1 - base_rate) / (1 - share))
    return Model(weights, center, scale, fit_logistic((features - center) / scale, labels.astype(float), weight))


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN,
        fit_chars: int = FIT_CHARS) -> Model | None:
    """Learn from the documents with a toxic label: at most about `fit_toxic` toxic and `fit_clean` other ones of up to
    `fit_chars` characters, chosen by a hash of the id. Without both kinds there is no model (None)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    counts = {bool(r["bad"]): r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = [int(min(1, most / counts[bad]) * (1 << 30)) + 1 for bad, most in ((True, fit_toxic), (False, fit_clean))]
    chosen = known.where(place < F.when(F.col("toxic") > 0, limits[0]).otherwise(limits[1]))  # about fit_toxic + fit_clean ids
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, fit_chars)).join(F.broadcast(chosen), "doc_id")
    sample = texts.select(F.xxhash64("text").alias("place"), "text", (F.col("toxic") > 0).alias("bad")).distinct().collect()
    sample.sort(key=lambda r: (r["place"], r["text"]))
    return fit_texts([r["text"] for r in sample], np.array([r["bad"] for r in sample]), counts[True] / sum(counts.values()))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add toxicity (0 to 1, from the whole text) and worst_at (the byte where the most toxic window begins, null for a
    wordless text).

    Needs text; all rows and other columns are kept, columns of the two names replaced. Null, empty and wordless texts
    score 0; without a model every score is 0. Repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        if shared.value is None:
            return [pa.array([0.0] * batch.num_rows), pa.nulls(batch.num_rows, pa.int64())]
        windows = Windows(text_of(batch))
        features, top = windows.document_features(windows.scores(shared.value.weights))
        starts = windows.starts[top] - windows.places if len(windows.starts) else top
        empty = np.asarray(top) < 0
        return [pa.array(np.where(empty, 0.0, shared.value.probability(features))), pa.array(np.maximum(0, starts), pa.int64(), mask=empty)]

    return with_columns(docs, FIELDS, compute)
