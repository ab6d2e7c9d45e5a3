"""Language ID by a string kernel: which n-grams two texts share, whatever their counts.

A text is cut into segments of about SEGMENT bytes. The blended-spectrum presence kernel of two segments is the number of
hashed n-grams (2 to 4 bytes of lower-cased text) that both hold, over the geometric mean of how many each holds. Nystroem
features come from landmark segments, one ridge regression per language is fitted on them (one against the rest), and
the dual weights are folded over the landmarks, so a batch is scored by one product of its presence matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import text_of, utf8, with_columns

SEGMENT = 1024
BITS = 13
ORDERS = (2, 3, 4)
LANDMARKS = 400
FIT_DOCS = 300
FIT_SEGMENTS = 2
RIDGE = 1.0
SCORED_SEGMENTS = 256
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True


def segments(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first byte of each segment (one more entry for the end) and each segment's text.

    A text of n bytes has max(1, round(n / SEGMENT)) segments of equal length.
    """
    data, offsets = utf8(pc.utf8_lower(column))
    sizes = np.diff(offsets)
    counts = np.maximum(1, (sizes + SEGMENT // 2) // SEGMENT)
    rows = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[rows] + within * sizes[rows] // counts[rows]
    return data, np.r_[starts, len(data)], rows


def presence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Row s marks the hashed n-grams that begin in segment s; `ends` bounds their bytes."""
    held = np.zeros((len(starts) - 1, 1 << BITS), bool)
    rows = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    first, limit = starts[0], np.repeat(ends, np.diff(starts))
    codes = data[first:].astype(np.uint32) + np.uint32(1)
    hashes = codes[: len(rows)].copy()
    at = np.arange(len(rows))
    for n in range(2, max(ORDERS) + 1):
        hashes = hashes[: max(0, len(codes) - n + 1)] * np.uint32(0x01000193) + codes[n - 1: n - 1 + len(hashes)]
        if n in ORDERS:
            fits = at[: len(hashes)] + first + n <= limit[: len(hashes)]
            slots = (hashes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            held[rows[: len(hashes)][fits], slots[fits]] = True
    return held


def unit_rows(held: np.ndarray) -> np.ndarray:
    """Presence rows scaled to length 1, so that their products are the kernel."""
    x = held.astype(np.float32)
    x /= np.sqrt(np.maximum(1, held.sum(axis=1, dtype=np.float32)))[:, None]
    return x


class Model:
    """Languages and the folded weights of each."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scores(self, column: pa.Array) -> np.ndarray:
        """One row per text: the mean over its segments of each language's regression value."""
        data, starts, rows = segments(column)
        text_ends = starts[1:][np.r_[rows[1:] != rows[:-1], True]][rows] if len(rows) else rows
        total = np.zeros((len(column), len(self.names)))
        for a in range(0, len(rows), SCORED_SEGMENTS):
            b = min(a + SCORED_SEGMENTS, len(rows))
            begin, stop = starts[a], min(text_ends[b - 1], starts[b] + max(ORDERS))  # n-grams may reach into what follows
            x = unit_rows(presence(data[begin:stop], starts[a: b + 1] - begin, np.minimum(text_ends[a:b], stop) - begin))
            np.add.at(total, rows[a:b], x @ self.weights)
        return total / np.maximum(1, np.bincount(rows, minlength=len(column)))[:, None]


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether a text holds any letter of any script."""
    data, offsets = utf8(column)
    ascii_letters = np.r_[0, np.cumsum(LETTERS[data])]
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(map(str.isalpha, column[int(k)].as_py()))
    return found


def fit_arrays(x: np.ndarray, labels: np.ndarray, names: list[str], landmarks: int) -> Model:
    """Nystroem features over landmarks spread evenly over the languages, then ridge regression one against the rest."""
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(labels == k)[:each] for k in range(len(names))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-4 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    z = (x @ marks.T) @ root
    y = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    # every language weighs the same
    weight = (1 / np.bincount(labels, minlength=len(names)))[labels] * len(labels) / len(names)
    beta = np.linalg.solve((z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1]), (z * weight[:, None]).T @ y)
    return Model(names, (marks.T @ (root @ beta)).astype(np.float32))


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from text and non-null lang; at most about `fit_docs` documents per language, chosen by a hash of the text,
    with FIT_SEGMENTS segments each from anywhere in the text. Without any such text the model is None."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[x for lang, n in counts.items() for x in (
        F.lit(lang), F.lit(int(min(1, fit_docs / n) * (1 << 30)) + 1))]), F.col("lang"))
    sample = usable.where(place < limit)

    def compute(batch):
        column = text_of(batch)
        data, starts, rows = segments(column)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        found = []
        for a, b, letters in zip(bounds[:-1], bounds[1:], has_letter(column)):
            picked = sorted({a + (b - a - 1) * k // max(1, FIT_SEGMENTS - 1) for k in range(FIT_SEGMENTS)}) if letters else []
            found.append([data[starts[k]: starts[k + 1]].tobytes() for k in picked])
        return [pa.array(found, pa.list_(pa.binary()))]

    fields = T.StructType([T.StructField("parts", T.ArrayType(T.BinaryType()))])
    parts = with_columns(sample, fields, compute).select("lang", F.explode("parts").alias("part")).distinct()
    rows = sorted((r["lang"], bytes(r["part"])) for r in parts.collect())  # fit_docs x FIT_SEGMENTS x SEGMENT bytes a language
    names = sorted({lang for lang, _ in rows})
    if not names:
        return None
    rows.sort(key=lambda r: hash_order(r[1]))
    labels = np.array([names.index(lang) for lang, _ in rows])
    data = np.frombuffer(b"".join(p for _, p in rows), np.uint8)
    starts = np.r_[0, np.cumsum([len(p) for _, p in rows])]
    return fit_arrays(unit_rows(presence(data, starts, starts[1:])), labels, names, landmarks)


def hash_order(part: bytes) -> int:
    """A fixed shuffle of the sample."""
    return int.from_bytes(part[:64], "little") * 0x9E3779B97F4A7C15 % (1 << 61)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and lang_score (0 to 1) from the whole text of each document.

    Needs text; all rows and other columns are kept, columns of the two names replaced. A text that is null or holds no
    letter is `und` with score 0, and so is every text where nothing could be learnt. Ties go to the first language by
    name; repeated rows get equal results. The model is broadcast: languages x 2^BITS numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        column, n = text_of(batch), batch.num_rows
        if shared.value is None:
            return [pa.array(["und"] * n), pa.array([0.0] * n)]
        names = np.array(shared.value.names, object)
        values = shared.value.scores(column)
        odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        known = has_letter(column)
        return [pa.array(np.where(known, names[values.argmax(axis=1)], "und"), pa.string()),
                pa.array(np.where(known, 1 / odds.sum(axis=1), 0.0))]

    return with_columns(docs, FIELDS, compute)
