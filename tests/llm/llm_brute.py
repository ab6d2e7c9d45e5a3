"""Plain Python counterparts of the text operators, and rows with every edge case."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import public_tokenizers
import tiktoken

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def frame(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text[, lang, source]), in several partitions."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def save(spark, folder, rows, **tables):
    """A folder of tables: documents from rows, others as DataFrames."""
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


EDGES = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "a"), (5, "Ünï çödé — 汉字 🙂 é"), (6, "word " * 3000), (7, "x" * 5000),
    (8, "The quick brown fox\njumps over\nthe lazy dog."), (8, "The quick brown fox\njumps over\nthe lazy dog."),
    (9, "The quick brown fox\njumps over\nthe lazy dog."), (None, "row without an id"), (10, "\x00\x1f tab\there\x0b\x0c\r\nend"),
    (11, "123 456  789 x"), (12, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4),
]


def bpe_ids(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [coder.encode_ordinary(t or "") for t in texts]


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def overlap_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def overlap(rows, items):
    windows = {}
    for item, text in items:
        words = overlap_words(text)
        for k in range(max(1, len(words) - 12)) if words else ():
            windows.setdefault(tuple(words[k: k + 13]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = overlap_words(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[k: k + size])):
                    hit |= set(range(k, k + size))
                    found |= ids
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found)).encode()),
                    bool(hit) and 20 * len(hit) >= len(words)))
    return out


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_base(text):
    words = spaced_words(text)
    lines = [x for x in (text or "").split("\n") if spaced_words(x)]
    windows = Counter(tuple(words[k: k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k: k + 3])] > 1 for j in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def removed_bytes(texts, size=200):
    """For each text the mask of bytes covered by a string of `size` bytes that starts anywhere else too."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[k: k + size] for d in raw for k in range(len(d) - size + 1))
    masks = []
    for d in raw:
        mask = bytearray(len(d))
        for k in range(len(d) - size + 1):
            if seen[d[k: k + size]] > 1:
                mask[k: k + size] = b"\x01" * size
        masks.append(mask)
    return raw, masks


def near_components(rows, limit=85):
    """(n_shingles, component) by id, comparing all pairs; ids are distinct."""
    sets = {}
    for doc, text in rows:
        words = spaced_words(lower_ascii(text))
        sets[doc] = {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def crc(text):
    return zlib.crc32((text or "").encode())


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def planted_words(doc, text):
    """Words of a document, every tenth document repeating a block of them up to its end."""
    words = spaced_words(text)
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_runs(words, min_length=6, min_exponent=4):
    """Maximal runs by comparing every word with the one a period before it."""
    out = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i: j + q]
            smallest = all(any(run[k] != run[k + p] for k in range(len(run) - p)) for p in range(1, q))
            if j > i and len(run) >= max(min_length, min_exponent * q) and smallest:
                out.append((i, len(run), q))
            i = max(j, i + 1)
    return sorted(out)


def run_facts(doc, text):
    words = planted_words(doc, text)
    runs = periodic_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(kept.encode()))


def rebuilt_conversations(rows):
    """conv_id to its turns (role, text), the head of every fifth conversation put before others."""
    own = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie_nodes(convs):
    """Every node of the trie over conversations (conv_id to turns), by listing all prefixes."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        gain = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p],
                    sha(",".join(map(str, ends)).encode())))
    return out
