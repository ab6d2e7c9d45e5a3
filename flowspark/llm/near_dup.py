"""Near-duplicate documents by a MinHash LSH forest.

A document's set is its distinct word shingles. Documents with equal sets become one node. Each tree of the forest
sorts all nodes by DEPTH MinHash values; nodes that stand close in such an order and share a prefix of at least
`min_depth` values are candidates, so a crowded region is searched among its longest common prefixes and a sparse one
down to min_depth. The sort cuts regions anywhere: partitions hand their edges on, and none needs a whole region.

Candidates are confirmed on full sets, in rounds, each on pairs that earlier ones have not joined: neighbours in two
trees first, then the best pair for any two components, then every remaining pair whose signatures don't rule the link
out. What is left are pairs of a region that don't stand close: in each region with more rows than the neighbours cover
and more than one component, the rows outside its largest component are compared with all others, in blocks of bounded
size. So every pair that shares a region ends confirmed, ruled out or inside one component. Components grow by
contraction, see `components`.

At similarity j a pair misses all regions with probability (1 - j^min_depth)^trees: 2.4e-7 at 0.85 for 3 and 16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import row_key, text_of, utf8, with_columns
from flowspark.llm.components import connected_components
from flowspark.llm.textops import LOWER, SPACED, mix, span_ids, spans_where, window_hashes
from flowspark.session import materialize

SHINGLE = 5
TREES, DEPTH, MIN_DEPTH = 16, 8, 3
NEIGHBOURS = 2
MARGIN = 0.18  # of estimated below wanted similarity, over 5 standard errors of 128 values
BUCKETS = 1 << 20
BLOCK_SHINGLES = 1_000_000  # of the rows of a region that one task compares with as many

_random = np.random.default_rng(99)
HASH_XOR = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
HASH_MULTIPLY = _random.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SET_FIELDS = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("signature", T.BinaryType())])
#: kind 0: a candidate pair; 1 and 2: rows at the beginning and the end of a sorted partition.
PAIR_SCHEMA = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("tree", T.IntegerType()),
    T.StructField("prefix", T.BinaryType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
    T.StructField("n_a", T.LongType()), T.StructField("distance", T.IntegerType())])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes; fewer words than `size` make one shingle."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, rows = spans_where(SPACED[data], offsets)
    words = span_ids(data, starts, ends)[0]
    shingles, at = window_hashes(words, rows, size)
    word_bounds = np.searchsorted(rows, np.arange(len(column) + 1))
    bounds = np.searchsorted(rows[at], np.arange(len(column) + 1))
    out = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    for k in np.flatnonzero((np.diff(word_bounds) > 0) & (np.diff(word_bounds) < size)):
        a, b = word_bounds[k], word_bounds[k + 1]
        out[k] = window_hashes(words[a:b], rows[a:b], b - a)[0]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES x DEPTH MinHash values of 16 bits for each set; all must have members."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    members = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        least = np.minimum.reduceat((members ^ HASH_XOR[k]) * HASH_MULTIPLY[k], starts)
        out[:, k] = mix(least.astype(np.uint64)) >> np.uint64(48)
    return out


def with_sets(docs: DataFrame, size: int) -> DataFrame:
    """row_key, doc_id, n_shingles, the set's 128-bit identity and its signature (null for an empty set)."""

    def compute(batch):
        sets = shingle_sets(text_of(batch), size)
        counts = np.array([len(s) for s in sets], np.int64)
        ids = np.zeros((2, len(sets)), np.uint64)
        for k, members in enumerate(sets):
            ids[:, k] = mix(members).sum(dtype=np.uint64), mix(members ^ np.uint64(0x5BD1E995A5A5A5A5)).sum(dtype=np.uint64)
        some = np.flatnonzero(counts)
        values = [None] * len(sets)
        if len(some):
            for k, row in zip(some, signatures([sets[k] for k in some]).astype(">u2")):
                values[k] = row.tobytes()
        empty = counts == 0
        return [pa.array(counts), pa.array(ids[0].view(np.int64), mask=empty), pa.array(ids[1].view(np.int64), mask=empty),
                pa.array(values, pa.binary())]

    keyed = docs.select(row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
    return with_columns(keyed, SET_FIELDS, compute).drop("text")


def close_in_order(min_depth: int, neighbours: int, similarity: float):
    """Over a sorted partition of (tree, prefix, node, n): pairs of close rows that share enough of their prefixes."""
    share = 2 * min_depth

    def rows_of(table: dict, kind: int, part: int, at: np.ndarray) -> pa.RecordBatch:
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(table["tree"][at]),
             pa.array([table["prefix"][k] for k in at], pa.binary()), pa.array(table["node"][at]), pa.nulls(n, pa.int64()),
             pa.array(table["n"][at]), pa.array(np.arange(n, dtype=np.int32))], names=PAIR_SCHEMA.names)

    def run(batches):
        part, held, begun = TaskContext.get().partitionId(), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {"tree": batch.column(0).to_numpy(), "prefix": np.array(batch.column(1).to_pylist(), object),
                   "node": batch.column(2).to_numpy(), "n": batch.column(3).to_numpy()}
            old = 0
            if held is not None:
                old = len(held["node"])
                now = {k: np.concatenate([held[k], now[k]]) for k in now}
            if not begun:
                begun = True
                yield rows_of(now, 1, part, np.arange(min(neighbours, len(now["node"]))))
            starts = np.frombuffer(b"".join(p[:share] for p in now["prefix"]), f"V{share}")
            for d in range(1, neighbours + 1):
                second = np.arange(max(d, old), len(now["node"]))
                first = second - d
                ok = (now["tree"][first] == now["tree"][second]) & (starts[first] == starts[second])
                ok &= fits(now["n"][first], now["n"][second], similarity)
                first, second = first[ok], second[ok]
                n = len(first)
                if n:
                    a, b = now["node"][first], now["node"][second]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(now["tree"][first]),
                         pa.nulls(n, pa.binary()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)),
                         pa.nulls(n, pa.int64()), pa.array(np.full(n, d, np.int32))], names=PAIR_SCHEMA.names)
            held = {k: v[-neighbours:] for k, v in now.items()}
        if held is not None:
            yield rows_of(held, 2, part, np.arange(len(held["node"])))

    return run


def fits(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be that similar."""
    return np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-9


def across_edges(edges: list, min_depth: int, neighbours: int, similarity: float) -> list[tuple]:
    """Candidate pairs whose rows lie in different partitions: (tree, a, b, distance)."""
    parts: dict[int, dict[int, list]] = {}
    for row in edges:
        parts.setdefault(row["part"], {}).setdefault(row["kind"], []).append(row)
    out, before = [], []
    for part in sorted(parts):
        heads = sorted(parts[part][1], key=lambda r: r["distance"])
        tails = sorted(parts[part][2], key=lambda r: r["distance"])
        for k, row in enumerate(heads):
            for d in range(k + 1, min(neighbours, k + len(before)) + 1):
                other = before[-(d - k)]
                if (other["tree"] == row["tree"] and other["prefix"][: 2 * min_depth] == row["prefix"][: 2 * min_depth]
                        and fits(other["n_a"], row["n_a"], similarity)):
                    out.append((row["tree"], min(other["a"], row["a"]), max(other["a"], row["a"]), d))
        before = [*before, *tails][-neighbours:] if len(tails) < neighbours else tails
    return out


def tree_rows(nodes: DataFrame, *columns: str, length: int = DEPTH) -> DataFrame:
    """One row per tree and node: tree, prefix (`length` values), node and other columns."""
    prefix = lambda t: F.call_function("substring", F.col("signature"), t * (2 * DEPTH) + 1, F.lit(2 * length))
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), prefix(t).alias("prefix")))
    return nodes.select("node", *columns, F.explode(trees).alias("t")).select("t.tree", "t.prefix", "node", *columns)


def candidates(nodes: DataFrame, similarity: float, min_depth: int, neighbours: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes, in how many trees they are close, and whether they are next in one of the first two."""
    forest = tree_rows(nodes.withColumnRenamed("n_shingles", "n"), "n").repartitionByRange("tree", "prefix", "node")
    rows = materialize(forest.sortWithinPartitions("tree", "prefix", "node").mapInArrow(
        close_in_order(min_depth, neighbours, similarity), PAIR_SCHEMA), "pairs")
    edges = rows.where("kind > 0").collect()  # at most 2 x neighbours rows per partition
    pairs = rows.where("kind = 0").select("tree", "a", "b", "distance")
    across = across_edges(edges, min_depth, neighbours, similarity)
    if across:
        pairs = pairs.union(nodes.sparkSession.createDataFrame(across, "tree int, a long, b long, distance int"))
    return materialize(pairs.groupBy("a", "b").agg(
        F.count("*").alias("trees"), F.max((F.col("distance") == 1) & (F.col("tree") < 2)).alias("first")), "candidates")


def texts_of(docs: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """Stored (node, text) for some of the nodes (distinct). A bitmap of BUCKETS bits spares most other texts the
    shuffle; the join is exact whatever it lets through."""
    wanted = nodes.join(some, "node").select("node", "row_key")
    bucket = F.pmod(F.xxhash64("row_key"), F.lit(BUCKETS)).cast("int")
    marks = np.zeros(BUCKETS, bool)
    marks[[r[0] for r in wanted.select(bucket).distinct().collect()]] = True  # at most BUCKETS numbers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def let_through(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(2).to_numpy()]))

    keyed = docs.select(row_key("doc_id", "text").alias("row_key"), "text").withColumn("bucket", bucket)
    passed = keyed.mapInArrow(let_through, keyed.schema).drop("bucket")
    return materialize(passed.join(wanted, "row_key").dropDuplicates(["node"]).select("node", "text"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    percent = round(similarity * 100)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compute(batch):
        sets = [shingle_sets(text_of(batch, c), size) for c in ("text_a", "text_b")]
        linked = []
        for x, y in zip(*sets):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        return [pa.array(linked, pa.bool_())]

    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    marked = with_columns(joined, T.StructType([T.StructField("linked", T.BooleanType())]), compute, column="text_a")
    return materialize(marked.where("linked").select("a", "b"), "links")


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose signatures agree in enough values."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("s_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("s_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    least = (similarity - MARGIN) * TREES * DEPTH

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of different components, with the components' roots x < y."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("x_"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("y_"))
    x, y = F.coalesce("x_", "a"), F.coalesce("y_", "b")
    return pairs.join(left, "a", "left").join(right, "b", "left").where(x != y).select(
        *pairs.columns, F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links (a, b, between nodes) are added."""
    more = connected_components(apart(links, roots).select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = more.join(roots.select("node"), "node", "left_anti")
    return materialize(kept.union(new.select("node", "root")), "roots")


def crowded_regions(nodes: DataFrame, roots: DataFrame, min_depth: int, neighbours: int) -> DataFrame:
    """Rows of the regions that hold more rows than the neighbours cover and more than one component: tree, prefix, node,
    root, whether it is outside the region's largest component, and in how many blocks rows (`blocks`) and rows outside
    the largest component (`groups`) are cut."""
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialize(tree_rows(rooted, "root", "n_shingles", length=min_depth), "regions")
    counts = rows.groupBy("tree", "prefix", "root").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("size"))
    regions = counts.groupBy("tree", "prefix").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("components"), F.sum("size").alias("size"),
        F.max(F.struct("rows", "root", "size")).alias("largest")).where(
        f"components > 1 AND rows > {neighbours + 1}").select(
        "tree", "prefix", F.col("largest.root").alias("largest"), F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks"),
        F.ceil((F.col("size") - F.col("largest.size")) / BLOCK_SHINGLES).cast("int").alias("groups"))
    return materialize(rows.drop("n_shingles").join(regions, ["tree", "prefix"]).withColumn(
        "outside", F.col("root") != F.col("largest")).drop("largest"), "crowded")


def compare_blocks(min_depth: int, similarity: float, size: int):
    """Over one block of rows and one of rows outside the largest component: a link for each of the latter to every other
    component that has one. A pair is looked at in the first tree where it shares a region."""
    percent, least = round(similarity * 100), (similarity - MARGIN) * TREES * DEPTH

    def run(table: pa.Table) -> pa.Table:
        text, outside = table.column("text").combine_chunks(), np.asarray(table.column("asks"))
        node, root = np.asarray(table.column("node")), np.asarray(table.column("root"))
        tree = int(np.asarray(table.column("tree"))[0])
        sets = shingle_sets(text, size)
        values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(sets), TREES, DEPTH)
        prefixes, flat = values[:, :, :min_depth], values.reshape(len(sets), -1)
        counts = np.array([len(s) for s in sets])
        members = np.flatnonzero(~outside)
        found = []
        for k in np.flatnonzero(outside):
            other = members[(root[members] != root[k]) & fits(counts[members], counts[k], similarity)]
            shared = (prefixes[other] == prefixes[k]).all(axis=2)
            other = other[shared.argmax(axis=1) == tree]
            other = other[(flat[other] == flat[k]).sum(axis=1) >= least]
            if not len(other):
                continue
            joined = np.concatenate([sets[m] for m in other])
            at = np.minimum(np.searchsorted(sets[k], joined), counts[k] - 1)
            sizes = counts[other]
            both = np.add.reduceat((sets[k][at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
            linked = other[100 * both >= percent * (counts[k] + sizes - both)]
            _, first = np.unique(root[linked], return_index=True)
            found += [(min(node[k], node[m]), max(node[k], node[m])) for m in linked[first]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def links_in_regions(docs: DataFrame, nodes: DataFrame, rows: DataFrame, min_depth: int, similarity: float, size: int) -> DataFrame:
    """Links (a, b) that the crowded regions still hold between components."""
    texts = texts_of(docs, nodes, rows.select("node").distinct())
    pick = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumns({"block": pick("blocks"), "group": every("groups"), "asks": F.lit(False)})
    asking = rows.where("outside").withColumns({"block": every("blocks"), "group": pick("groups"), "asks": F.lit(True)})
    keys = ["tree", "prefix", "block", "group"]
    full = members.union(asking).select(*keys, "asks", "node", "root").join(nodes.select("node", "signature"), "node").join(texts, "node")
    return materialize(full.groupBy(*keys).applyInArrow(compare_blocks(min_depth, similarity, size), "a long, b long"), "links")


def near_components(docs: DataFrame, similarity: float = 0.8, shingle: int = SHINGLE, min_depth: int = MIN_DEPTH,
                    neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): row_key, doc_id, n_shingles, component_id and kept.

    Documents are linked if their sets of `shingle`-word shingles (ASCII letters lower-cased, words ended by white
    space; fewer words are one shingle) have a Jaccard similarity of at least `similarity`, counted in whole percent.
    component_id is the least doc_id that links reach; kept says that it is the document's own. Null, empty and
    wordless texts have no shingles and are linked with nothing. A null id counts as larger than any other; rows that
    share an id are kept together. Repeated rows are the same document. Other columns are ignored. `row_key` tells rows
    with different id or text apart.
    """
    sets = materialize(with_sets(docs, shingle), "sets")
    groups = sets.where("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"),
        F.min("row_key").alias("row_key"), F.first("signature").alias("signature"))
    nodes = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = candidates(nodes, similarity, min_depth, neighbours)
    roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    if not pairs.isEmpty():
        texts = texts_of(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        roots = connected_components(confirmed(pairs.where("first"), texts, similarity, shingle))
        rest = materialize(plausible(apart(pairs.where("NOT first"), roots), nodes, similarity), "rest")
        best = apart(rest, roots).groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        roots = joined_roots(roots, confirmed(best, texts, similarity, shingle))
        others = apart(rest, roots).select("a", "b").join(best, ["a", "b"], "left_anti")
        roots = joined_roots(roots, confirmed(others, texts, similarity, shingle))
        rows = crowded_regions(nodes, roots, min_depth, neighbours)
        if not rows.isEmpty():
            roots = joined_roots(roots, links_in_regions(docs, nodes, rows, min_depth, similarity, shingle))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(least, "root").select("set_a", "set_b", "component_id")
    joined = sets.select("row_key", "doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("row_key", "doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents with the least id of their components, unchanged."""
    gone = near_components(docs.select("doc_id", "text"), similarity).where("NOT kept").select(
        F.col("row_key").alias("_gone")).distinct()
    return docs.withColumn("_row_key", row_key("doc_id", "text")).join(
        gone, F.col("_row_key") == F.col("_gone"), "left_anti").drop("_row_key")
