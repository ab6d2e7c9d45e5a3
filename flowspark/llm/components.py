"""Connected components of a graph given as edges, by repeated contraction.

Each round every node points to its least neighbour if that is less than itself. The pointers form trees, and pointer
jumping (every node takes its target's target until no target moves) brings each node to its tree's root in as many steps as
the logarithm of the tree's depth, so a chain in ascending order is one round. Then edges are relabelled by the roots and
deduplicated, and inner edges vanish; when none is left, composing the rounds' pointers gives each node the least node
of its component. Only keyed aggregations and joins are used (adaptive execution splits the joins of crowded nodes);
every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long, not null); root is the least node that can be reached."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        pointers = tree_roots(both.groupBy("a").agg(F.min("b").alias("to")).select(
            F.col("a").alias("node"), F.least("a", "to").alias("to")))
        rounds.append(pointers)
        left = pointers.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = pointers.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for pointers in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = materialize(pointers.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots


def tree_roots(pointers: DataFrame) -> DataFrame:
    """(node, to) where `to` is the root that following the pointers ends at; a root points to itself, others to less."""
    pointers = materialize(pointers, "pointers")
    while True:
        following = pointers.where("to < node").select(F.col("node").alias("to"), F.col("to").alias("further"))
        moves = pointers.join(following, "to")  # only nodes whose target is no root
        if moves.isEmpty():
            return pointers
        jumped = pointers.join(following, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        pointers = materialize(jumped, "pointers")
