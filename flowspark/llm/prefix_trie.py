"""The prefix trie of conversations: which of them begin with the same turns, and what sharing those would save.

Equal conversations become one sequence of turn ids first. The distinct sequences are sorted across partitions; inside a
partition, the longest common prefix of neighbours is an edge between them, and a union-find takes the edges in descending
depth: every merge of components, at one depth, creates the branching node of that depth, and the turns between a node and
the branching node above it are its unary chain. What a node counts is a sum over its component in which every deeper node
belongs to the sequence that opens it, so the sums of two partitions simply add up: the nodes on a partition's outer paths,
those that it shares with a neighbour, leave it as contracted partial rows, one a depth, and are merged by their prefix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import lookup_join, materialize

LONG, TEXT = T.LongType(), T.StringType()
#: Sums of a node that partitions add up; `conv_id` is the smallest member and merges by minimum.
SUMS = ["n_convs", "n_children", "n_leaves", "shared", "distinct"]
NODE = T.StructType([T.StructField("depth", LONG), T.StructField("prefix", TEXT), T.StructField("parent", TEXT),
                     T.StructField("conv_id", LONG), T.StructField("parent_conv_id", LONG), T.StructField("seq_key", TEXT)]
                    + [T.StructField(n, LONG) for n in SUMS])
ROOT = "-"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text): conv_id and seq, its turns in order as structs of two
    64-bit ids and the text's bytes.

    Turns go by `turn` (null first), ties by content; a null role or text counts as empty; rows without a conv_id belong to
    no conversation. Only these fixed-size ids are gathered, never the texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct(
            F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"),
            F.xxhash64(F.lit(2), text, role).alias("b"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["size"].alias("size"))).alias("seq"))


def sequences(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct sequences with n and the smallest conv_id, stored; conv_id and seq_key of every conversation)."""
    keyed = materialize(convs.withColumn("seq_key", F.concat_ws(
        "-", F.hex(F.xxhash64(F.lit(1), "seq")), F.hex(F.xxhash64(F.lit(2), "seq")))), "conversations")
    # all rows of a key hold the same sequence, and the shuffle carries it once a task
    distinct = keyed.groupBy("seq_key").agg(F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return materialize(distinct, "sequences"), keyed.select("conv_id", "seq_key")


class Sequences:
    """A sorted partition's sequences as flat arrays."""

    def __init__(self, table: pa.Table):
        column = table.column("seq").combine_chunks()
        flat = column.flatten()
        self.offsets = np.r_[0, np.cumsum(column.value_lengths().to_numpy(False))].astype(np.int64)
        self.a, self.b = flat.field("a").to_numpy(False), flat.field("b").to_numpy(False)
        self.lengths = np.diff(self.offsets)
        self.bytes = np.r_[0, np.cumsum(flat.field("size").to_numpy(False))]
        self.n, self.conv_id = table.column("n").to_numpy(), table.column("conv_id").to_numpy()
        self.keys = table.column("seq_key").to_pylist()

    def common(self) -> np.ndarray:
        """Longest common prefix of each sequence and the one before it (0 for the first), all neighbours at once."""
        found = np.zeros(len(self.lengths), np.int64)
        open_ = np.arange(1, len(self.lengths))
        depth = 0
        while len(open_):
            open_ = open_[np.minimum(self.lengths[open_], self.lengths[open_ - 1]) > depth]
            here, before = self.offsets[open_] + depth, self.offsets[open_ - 1] + depth
            open_ = open_[(self.a[here] == self.a[before]) & (self.b[here] == self.b[before])]
            depth += 1
            found[open_] = depth
        return found

    def upto(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the first `depth` turns of sequences."""
        return self.bytes[self.offsets[at] + depth] - self.bytes[self.offsets[at]]

    def prefixes(self, at: int, most: int) -> list[str]:
        """Names of a sequence's prefixes of 0 to `most` turns."""
        state, names = hashlib.blake2b(digest_size=16), [ROOT]
        for k in range(int(self.offsets[at]), int(self.offsets[at]) + most):
            state.update(self.a[k].tobytes() + self.b[k].tobytes())
            names.append(state.hexdigest())
        return names


def merge_components(lengths: np.ndarray, lcp: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Nodes (first sequence, last sequence, depth, depth of the node above, smallest id) of the compressed trie below the root.

    Sequences start as components of their own length. Edges between neighbours are taken from the deepest up; the
    components that one depth joins get one node of that depth, unless one of them has it already (a sequence that ends
    there). Edges of depth 0 join nothing below the root.
    """
    count = len(lengths)
    leader, last, depth, least = list(range(count)), list(range(count)), lengths.tolist(), ids.tolist()
    done: list[tuple[int, int, int, int, int]] = []

    def find(k: int) -> int:
        while leader[k] != k:
            leader[k] = leader[leader[k]]
            k = leader[k]
        return k

    def close(k: int, above: int) -> None:
        if depth[k] > above:
            done.append((k, last[k], depth[k], above, least[k]))
            depth[k] = above

    order = np.argsort(-lcp[1:], kind="stable") + 1
    for k, shared in zip(order.tolist(), lcp[order].tolist()):
        if not shared:
            break
        left = find(k - 1)
        close(left, shared)
        close(k, shared)  # the component on the right begins at k: no edge to its left is taken yet
        leader[k], last[left], least[left] = left, last[k], min(least[left], least[k])
    for k in range(count):
        if leader[k] == k:
            close(k, 0)
    return done


def partition_nodes(table: pa.Table, shared_before: int, shared_after: int) -> pa.Table:
    """The nodes of one sorted partition, whose first and last sequence share so many turns with its neighbours.

    Nodes of the outer paths down to these depths, and the root, are partial (`prefix` is set); others are whole.
    `parent` names a partial node above, whose smallest member is not known here.
    """
    s = Sequences(table)
    count, lcp = len(s.lengths), s.common()
    # depth from which a sequence opens nodes, and whether it goes on in the next one
    opens = np.r_[shared_before, lcp[1:]]
    ends_in_next = np.r_[lcp[1:], shared_after] >= s.lengths
    new_bytes = s.upto(np.arange(count), s.lengths) - s.upto(np.arange(count), opens)
    cum_n, cum_leaf = np.r_[0, np.cumsum(s.n)], np.r_[0, np.cumsum(~ends_in_next)]
    cum_bytes = np.r_[0, np.cumsum(s.n * s.upto(np.arange(count), s.lengths))]
    cum_new = np.r_[0, np.cumsum(new_bytes)]
    spans = merge_components(s.lengths, lcp, s.conv_id) + [(0, count - 1, 0, -1, int(s.conv_id.min()))]
    lo, hi, bottom, above, least = (np.array(x, np.int64) for x in zip(*spans))
    # sequences that open a child of a node at depth d share d turns with the one before them
    by_depth = np.lexsort((np.arange(count), opens))
    sorted_depths = opens[by_depth]
    children = np.zeros(len(lo), np.int64)
    for k in np.flatnonzero(hi > lo).tolist():
        x, y = np.searchsorted(sorted_depths, [bottom[k], bottom[k] + 1])
        children[k] = np.diff(np.searchsorted(by_depth[x:y], [lo[k], hi[k]], "right"))[0]
    children += (s.lengths[lo] > bottom) & ((lo > 0) | (bottom >= shared_before))

    # one row for each depth of a node's chain
    chain = bottom - above
    node = np.repeat(np.arange(len(lo)), chain)
    depth = np.repeat(bottom, chain) - (np.arange(len(node)) - np.repeat(np.cumsum(chain) - chain, chain))
    a, b = lo[node], hi[node]
    at_bottom = depth == bottom[node]
    # in a chain above its bottom the only child is the chain's next node, opened where that node is
    only = (a > 0) | (depth >= shared_before)
    head = np.maximum(depth - 1, 0)
    distinct = cum_new[b + 1] - cum_new[a + 1] + s.upto(a, s.lengths[a]) - s.upto(
        a, np.where(a > 0, head, np.maximum(head, shared_before)))
    sums = {
        "n_convs": cum_n[b + 1] - cum_n[a], "n_children": np.where(at_bottom, children[node], only),
        "n_leaves": cum_leaf[b + 1] - cum_leaf[a],
        "shared": cum_bytes[b + 1] - cum_bytes[a] - (cum_n[b + 1] - cum_n[a]) * s.upto(a, head), "distinct": distinct,
    }
    left_names, right_names = s.prefixes(0, shared_before), s.prefixes(count - 1, shared_after)
    on_left, on_right = (a == 0) & (depth < len(left_names)), (b == count - 1) & (depth < len(right_names))
    prefix = [left_names[d] if x else right_names[d] if y else None for d, x, y in zip(depth.tolist(), on_left.tolist(), on_right.tolist())]
    up = depth - 1
    on_left, on_right = spans_prefix(lcp, 0)[a] >= up, spans_prefix(lcp, count - 1)[a] >= up
    parent = [None if d < 0 else left_names[d] if x and d < len(left_names) else right_names[d] if y and d < len(right_names) else None
              for d, x, y in zip(up.tolist(), on_left.tolist(), on_right.tolist())]
    above_least = parent_least(lo, hi, bottom, above, least)
    parent_conv = np.where(depth - 1 > above[node], least[node], above_least[node])
    ends = at_bottom & (s.lengths[a] == depth)
    return pa.table({
        "depth": depth, "prefix": pa.array(prefix, pa.string()), "parent": pa.array(parent, pa.string()),
        "conv_id": least[node], "parent_conv_id": pa.array(parent_conv, mask=depth == 0),
        "seq_key": pa.array([s.keys[k] if e else None for k, e in zip(a.tolist(), ends.tolist())], pa.string()),
        **{n: sums[n].astype(np.int64) for n in SUMS}})


def spans_prefix(lcp: np.ndarray, to: int) -> np.ndarray:
    """How many turns each sequence shares with sequence `to`, the partition's first or last (itself: no bound)."""
    without = np.iinfo(np.int64).max
    if to == 0:
        return np.minimum.accumulate(np.r_[without, lcp[1:]])
    return np.minimum.accumulate(np.r_[lcp[1:], without][::-1])[::-1]


def parent_least(lo: np.ndarray, hi: np.ndarray, bottom: np.ndarray, above: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Smallest member of the node above each compressed node: the one of depth `above` that spans it."""
    order = np.lexsort((bottom, -hi, lo))  # parents come before the nodes they span
    found, stack = np.zeros(len(lo), np.int64), []
    for k in order.tolist():
        while stack and (hi[stack[-1]] < lo[k] or bottom[stack[-1]] > above[k]):
            stack.pop()
        found[k] = least[stack[-1]] if stack else -1
        stack.append(k)
    return found


def trie(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations (conv_id unique and not null, seq as of `conversations`; an empty one ends at the root).

    Returns its nodes and its members. Nodes: depth, conv_id (smallest member), parent_conv_id (null at the root), n_convs
    (members: conversations that begin with the node's turns), n_children, n_leaves (childless nodes below or at it),
    saved_bytes (over it and all nodes below: members less one, times the bytes of the last turn's text) and seq_key (null
    unless conversations end there). Members: conv_id and the seq_key of the node it ends at. Equal conversations share all
    their nodes; ties in turn order are settled by content. Without conversations there is no node, not even a root.
    """
    distinct, members = sequences(convs)
    path = F.transform("seq", lambda t: F.struct(t["a"], t["b"]))
    ranged = distinct.withColumn("path", path).repartitionByRange("path").sortWithinPartitions("path").drop("path")
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rank")),
                         "sorted-sequences")
    edges = placed.groupBy("part").agg(F.min(path).alias("low"), F.max(path).alias("high"))
    along = Window.orderBy("part")  # one row per partition
    following = F.lead("low").over(along)
    after = F.when(following.isNull(), -1).otherwise(_common(F.col("high"), following))  # nothing can go on in the last one
    shared = edges.select("part", _common(F.lag("high").over(along), F.col("low")).alias("before"), after.alias("after"))
    bounds = {r["part"]: (r["before"], r["after"]) for r in shared.collect()}  # two numbers per partition

    def nodes(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("rank")
        return partition_nodes(ordered, *bounds[key[0].as_py()]).select(NODE.names).cast(_arrow(NODE))

    # a group is what one task has sorted, so it is bounded like any partition
    found = materialize(placed.groupBy("part").applyInArrow(nodes, NODE), "trie-nodes")
    partial = found.where("prefix IS NOT NULL").groupBy("depth", "prefix").agg(
        *[F.max(c).alias(c) for c in ("parent", "seq_key", "parent_conv_id")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in SUMS])
    whole = found.where("prefix IS NULL").unionByName(partial)
    # a node right below a partial one does not know the smallest member above it
    tops = partial.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("top"))
    below = lookup_join(whole.where("parent IS NOT NULL"), tops, ["parent"]).withColumn("parent_conv_id", F.col("top")).drop("top")
    return whole.where("parent IS NULL").unionByName(below).select(
        "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("shared") - F.col("distinct")).alias("saved_bytes"), "seq_key"), members


def ids_digest(members: DataFrame) -> DataFrame:
    """seq_key and ends_sha256: SHA-256 of the ascending conv_ids that end there, in decimal, joined by commas.

    Sorted ranges of ids become blocks of text; the task that hashes a node's blocks holds one at a time, however many ids
    end there.
    """
    blocks = members.repartitionByRange("seq_key", "conv_id").sortWithinPartitions("seq_key", "conv_id").mapInArrow(
        _join_ids, "seq_key string, first long, ids string")
    return blocks.repartition("seq_key").sortWithinPartitions("seq_key", "first").mapInArrow(
        _hash_blocks, "seq_key string, ends_sha256 string")


def _join_ids(batches):
    for batch in batches:
        keys, ids = batch.column("seq_key").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)] if keys else []
        rows = [(keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["seq_key", "first", "ids"])


def _hash_blocks(batches):
    key, state = None, None

    def told(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], names=["seq_key", "ends_sha256"])

    for batch in batches:
        found = []
        for now, ids in zip(batch.column("seq_key").to_pylist(), batch.column("ids").to_pylist()):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                found.append((key, state.hexdigest()))
            key, state = now, hashlib.sha256(ids.encode())
        yield told(found)
    if key is not None:
        yield told([(key, state.hexdigest())])


def _common(left, right):
    """Length of the longest common prefix of two arrays; 0 where one is null."""
    both = F.arrays_zip(left.alias("l"), right.alias("r"))
    unequal = F.transform(both, lambda t: ~F.coalesce(t["l"] == t["r"], F.lit(False)))
    first = F.array_position(unequal, True)
    return F.coalesce(F.when(first == 0, F.least(F.size(left), F.size(right))).otherwise(first - 1).cast("long"), F.lit(0))


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, pa.string() if f.dataType == TEXT else pa.int64()) for f in schema])
