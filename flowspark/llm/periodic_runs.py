"""Periodic runs of words: stretches that repeat one block of words several times over.

The words of a text go through a suffix automaton, whose suffix links form a tree, and each appended word accesses the
path from its prefix's state to the root in a link-cut tree: the path's segments hold the end of the last occurrence of
their strings, and the access recolours all of them with the new end. Where the distance q of the two ends fits several
times into the length of a segment's longest string, that string and its last occurrence overlap in a repetition of
period q that begins a period before them; the last end that shows the same beginning and period completes the run.

Only windows of words that can hold a run enter the automaton: past its first period, every word of a run recurs within
the period, so a stretch of words that recur within a share of the stretch's length is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowspark.llm.common import text_of, with_columns

NARROWING_ROUNDS = 8
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                       T.StructField("collapsed_text", T.StringType())])


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of every state (state 0 is no state, 1 the empty string), and each prefix's state."""
    link, longest, following, prefixes = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for n, word in enumerate(words, 1):
        state = len(link)
        link.append(1)
        longest.append(n)
        following.append({})
        p = last
        while p and word not in following[p]:
            following[p][word] = state
            p = link[p]
        if p:
            q = following[p][word]
            if longest[q] != longest[p] + 1:
                clone = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                following.append(following[q].copy())
                link[q] = clone
                while p and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                q = clone
            link[state] = q
        prefixes.append(state)
        last = state
    return link, longest, prefixes


class LastOccurrences:
    """A link-cut tree over suffix links: every preferred path is a splay tree whose root holds the path's last end."""

    def __init__(self, link: list[int]):
        self.up = list(link)
        self.left, self.right, self.end = [0] * len(link), [0] * len(link), [-1] * len(link)
        self.up[1] = 0

    def splay(self, x: int) -> None:
        """Bring x to the root of its splay tree; the path's end moves with it."""
        up, left, right, end = self.up, self.left, self.right, self.end

        def rotate(x: int, p: int) -> None:
            g = up[p]
            if left[p] == x:
                child = left[p] = right[x]
                right[x] = p
            else:
                child = right[p] = left[x]
                left[x] = p
            if child:
                up[child] = p
            up[p], up[x] = x, g
            if g:
                if left[g] == p:
                    left[g] = x
                    return
                if right[g] == p:
                    right[g] = x
                    return
            end[x] = end[p]

        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    rotate(p, g)
                else:
                    rotate(x, p)
                    rotate(x, g)
                    continue
            rotate(x, up[x])

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from `state` to the root; the deepest state of each old segment and the segment's last end."""
        found, below, x = [], 0, state
        while x:
            self.splay(x)
            before = self.end[x]
            if self.right[x]:
                self.end[self.right[x]] = before
            self.right[x] = below
            if before >= 0:
                found.append((x, before))
            below, x = x, self.up[x]
        self.end[below] = end
        return found


def runs_of(words: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal runs of smallest period `period`, at least `min_length` words and
    `min_exponent` (three or more) periods long."""
    link, longest, prefixes = suffix_automaton(words)
    paths, ends = LastOccurrences(link), {}
    for end, state in enumerate(prefixes):
        for deepest, before in paths.access(state, end):
            period, length = end - before, longest[deepest]
            # two and more periods inside the string: no shorter period could leave its last occurrence this far back
            if length >= (min_exponent - 1) * period:
                ends[end - length - period + 1, period] = end
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items() if end - start + 1 >= min_length)


def windows(gaps: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Disjoint windows [a, b) that contain all runs whole; `gaps` is the distance to each word's previous occurrence.

    Past its first period a run of e or more periods is a stretch of words with gaps of at most a period, thus at most
    1 / (e - 1) of the stretch. Words with larger gaps cut the stretches until nothing changes, or for some rounds.
    """
    share, least = min_exponent - 1, min_length - min_length // min_exponent
    recurs = gaps <= len(gaps) // min_exponent
    starts = lengths = np.zeros(0, np.int64)
    for _ in range(NARROWING_ROUNDS):
        edges = np.flatnonzero(np.diff(np.r_[False, recurs, False]))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        limit = np.where(lengths >= least, lengths // share, -1)
        inside = np.repeat(limit, lengths)
        fits = gaps[recurs] <= inside
        if fits.all():
            break
        recurs[np.flatnonzero(recurs)[~fits]] = False
    found: list[tuple[int, int]] = []
    for start, length in zip(starts.tolist(), lengths.tolist()):
        if length < least:
            continue
        begin = max(0, start - length // share)
        if found and begin <= found[-1][1]:
            begin = min(begin, found.pop()[0])
            while found and begin <= found[-1][1]:
                begin = min(begin, found.pop()[0])
        found.append((begin, start + length))
    return found


def text_runs(words: list[bytes], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """Runs of a list of words, by start and then period."""
    if len(words) < min_length:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    order = np.argsort(ids, kind="stable")
    gaps = np.full(len(ids), len(ids) + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gaps[order[1:][same]] = (order[1:] - order[:-1])[same]
    runs = []
    for a, b in windows(gaps, min_length, min_exponent):
        runs += [(a + start, length, period) for start, length, period in runs_of(ids[a:b].tolist(), min_length, min_exponent)]
    return sorted(runs)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, n in zip(words, np.cumsum(gone).tolist()) if not n])


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Add n_words, runs (start, length, period in words, by start and then period) and collapsed_text, the text without
    the repeated part of each run, its words joined by one space.

    A run is a stretch of consecutive words with smallest period p, at least `min_length` words and `min_exponent` (three
    or more) times p long, that no neighbouring word extends keeping the period. Words end at ASCII white space and are
    compared whole. Needs text; a null, empty or blank text has no words, no runs and an empty collapsed text. Each text is
    judged by itself, so ties and repeated rows get equal results; all rows and other columns are kept, columns of the
    three names replaced. Time grows with n log n of a text's words, memory with its longest window of recurring words.
    """
    if min_exponent < 3:
        raise ValueError("runs need an exponent of three or more")

    def compute(batch):
        counts, sizes, flat, collapsed = [], [0], [], []
        for text in text_of(batch).cast(pa.large_binary()).to_pylist():
            words = (text or b"").split()
            runs = text_runs(words, min_length, min_exponent)
            counts.append(len(words))
            flat += runs
            sizes.append(len(flat))
            collapsed.append(collapse(words, runs))
        columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        runs = pa.StructArray.from_arrays(columns, names=[f.name for f in RUN])
        return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), runs),
                pa.array(collapsed, pa.binary()).cast(pa.string())]

    return with_columns(docs, FIELDS, compute)
