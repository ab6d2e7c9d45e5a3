"""Words, lines and windows of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODES, OTHER_CODES = np.random.default_rng(20240517).integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space ends.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of digits, lower-case letters and anything beyond ASCII (after LOWER).
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

TABLE_STEP = 1 << 16
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table_size(n: int) -> int:
    """Entries of a table for texts of `n` bytes: some more, so that growing texts seldom need a new one."""
    return -(-(n + n // 8) // TABLE_STEP) * TABLE_STEP


def power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = table_size(n)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def release_tables() -> None:
    """Forget the tables of powers, which follow the longest slice; a later task builds its own."""
    for tables in (_powers, _prime_powers):
        tables[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finalizer of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans_where(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross texts: starts, ends, and the text of each."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0] = after[-1] = False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What splitting each text at newlines gives, empty pieces included: starts, ends, text."""
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    rows_of_breaks = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.sort(np.concatenate([rows_of_breaks, np.arange(len(offsets) - 1)]), kind="stable")
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        starts[first] = offsets[:-1]
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from one prefix sum; other codes give an independent one."""
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


PRIME = np.uint64((1 << 61) - 1)
PRIME_BASE = 0x1B3E5A7C9D2F4681 % int(PRIME)
PRIME_CODES = np.random.default_rng(20250211).integers(1, 1 << 31, 256, dtype=np.int64).astype(np.uint64)
_prime_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def times_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below 2^61, modulo PRIME, from halves of 32 bits."""
    a1, a0, b1, b0 = a >> _u(32), a & _u(0xFFFFFFFF), b >> _u(32), b & _u(0xFFFFFFFF)
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    total = (a1 * b1 << _u(3)) + (middle >> _u(29)) + ((middle & _u((1 << 29) - 1)) << _u(32)) + (low & PRIME) + (low >> _u(61))
    return reduced(reduced(total))


def reduced(x: np.ndarray) -> np.ndarray:
    """Equal modulo PRIME and, taken twice, at most PRIME itself."""
    return (x & PRIME) + (x >> _u(61))


def prime_powers(n: int) -> list[np.ndarray]:
    """Powers of the base modulo PRIME, and of its inverse, at least `n` of each."""
    if len(_prime_powers[0]) < n:
        size = table_size(n)
        for k, base in enumerate((PRIME_BASE, pow(PRIME_BASE, -1, int(PRIME)))):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, times_mod(table, np.full(1, pow(base, len(table), int(PRIME)), np.uint64))])
            _prime_powers[k] = table[:size].copy()
    return _prime_powers


def prime_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of every span as a polynomial modulo PRIME: no set of texts is bound to collide, whatever the base."""
    power, inverse = prime_powers(len(data) + 1)
    sums = np.zeros((2, len(data) + 1), np.uint64)  # of the upper and the lower bits, so that no sum overflows
    for a in range(0, len(data), TABLE_STEP):
        b = min(a + TABLE_STEP, len(data))
        codes, now = PRIME_CODES[data[a:b]], power[a:b]
        high = codes * (now >> _u(31))  # below 2^61, to be shifted by 31
        values = reduced(((high & _u((1 << 30) - 1)) << _u(31)) + (high >> _u(30)) + codes * (now & _u((1 << 31) - 1)))
        for k, part in enumerate((values >> _u(31), values & _u((1 << 31) - 1))):
            part[0] += sums[k, a]
            np.cumsum(part, out=sums[k, a + 1: b + 1])
    upper, lower = reduced(sums[0][ends] - sums[0][starts]), sums[1][ends] - sums[1][starts]
    total = reduced(reduced(((upper & _u((1 << 30) - 1)) << _u(31)) + (upper >> _u(30)) + reduced(lower)))
    found = times_mod(total, inverse[starts])
    return np.where(found == PRIME, _u(0), found)


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the bytes of every span, as two numbers, from two unrelated polynomials (modulo 2^64 and PRIME)."""
    first = span_hashes(data, starts, ends)
    second = prime_hashes(data, starts, ends) + (ends - starts).astype(np.uint64)
    return mix(first ^ mix(second)), mix(second * _u(0x9E3779B97F4A7C15) + mix(first + _u(0x632BE59BD9B4E019)))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring spans of one text, and the index of the first of each."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:count].copy()
    for k in range(1, n):
        total *= BASE
        total += hashes[k: k + count]
    at = np.flatnonzero(rows[:count] == rows[n - 1:])
    return mix(total[at]), at


def per_text(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values by text."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def covered(firsts: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """Which of `total` positions lie in any run [first, first + length)."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, firsts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
