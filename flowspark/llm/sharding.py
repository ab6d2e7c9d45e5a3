"""Sharding by a Hilbert curve over quantised metadata, with DataFrame functions only.

Each row gets a cell of a grid over source, language, length and id range; the cell's place on the Hilbert curve orders
the table, and equal runs of that order become the shards, so a shard spans few values of each dimension and its files
can be skipped by any of them. The rank of a row needs no sort of the table: rows are counted by (cell, salt), running
sums of these counts (at most cells x salts, whatever the table's size) give each bucket's first rank, and only rows of
one bucket are ordered among themselves. The salt splits a cell that holds a large part of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 3
SALTS = 16


def hilbert_steps(dims: int) -> list[int]:
    """Transition table of the curve: for state (entry, direction) and corner, the packed digit and next state."""
    size = 1 << dims

    def rotate_left(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    def trailing_ones(x: int) -> int:
        n = 0
        while x & 1:
            n, x = n + 1, x >> 1
        return n

    rank_of_gray = {gray(i): i for i in range(size)}
    table = []
    for entry in range(size):
        for direction in range(dims):
            for corner in range(size):
                digit = rank_of_gray[rotate_left(corner ^ entry, dims - (direction + 1) % dims)]
                begin = 0 if digit == 0 else gray(2 * ((digit - 1) // 2))
                turn = 0 if digit == 0 else trailing_ones(digit if digit % 2 else digit - 1) % dims
                next_entry = entry ^ rotate_left(begin, direction + 1)
                next_state = next_entry * dims + (direction + turn + 1) % dims
                table.append(next_state * size + digit)
    return table


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place of a grid cell on the Hilbert curve; each coordinate is an int in [0, 2**bits)."""
    dims = len(coordinates)
    size = 1 << dims
    steps = F.lit(hilbert_steps(dims))

    def step(state: Column, level: Column) -> Column:
        corner = sum((F.call_function("shiftright", c, level).bitwiseAND(1) * (1 << k) for k, c in enumerate(coordinates)),
                     F.lit(0))
        code = F.get(steps, state["s"] * size + corner)
        return F.struct((state["h"] * size + code % size).cast("long").alias("h"),
                        F.floor(code / size).cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["h"])


def grid(df: DataFrame, bits: int) -> list[Column]:
    """Coordinates from source, lang, n_chars and doc_id; a null value takes a cell like any other."""
    top = (1 << bits) - 1
    low, high = df.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, ((high or 0) - (low or 0)) // (top + 1) + 1)
    return [
        F.pmod(F.xxhash64("source"), F.lit(top + 1)).cast("int"),
        F.pmod(F.xxhash64("lang"), F.lit(top + 1)).cast("int"),
        F.coalesce(F.least(F.lit(top), F.floor(F.log2(1 + F.greatest("n_chars", F.lit(0))) / 2)), F.lit(0)).cast("int"),
        F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / width), F.lit(0)).cast("int"),
    ]


def assign_shards(docs: DataFrame, shards: int = 40, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """Give every row of `docs` a shard in [0, shards) by equal row counts (law `rows`) and its slot there.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard (null: the law has no stable
    growth) and curve (the Hilbert index). A null text counts as empty, a null id sorts first. Repeated rows are kept
    and take slots of their own; an empty table gives no rows. Other columns are ignored. Needs an integer doc_id.
    """
    salt = F.pmod(F.xxhash64("doc_id", "n_chars", "source", "lang"), F.lit(salts)).cast("int")
    placed = docs.withColumns({"curve": hilbert_index(grid(docs, bits), bits), "salt": salt})
    counts = placed.groupBy("curve", "salt").agg(F.count("*").alias("rows"))
    # At most 2 ** (4 * bits) cells: their running sum is one bounded task.
    cells = counts.groupBy("curve").agg(F.sum("rows").alias("cell_rows"))
    in_order = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("cell_rows").over(in_order), F.lit(0)).alias("cell_first"),
                         F.sum("cell_rows").over(Window.partitionBy(F.lit(0))).alias("total"))
    within = Window.partitionBy("curve").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("salt_first", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(cells, "curve").select(
        "curve", "salt", "total", (F.col("cell_first") + F.col("salt_first")).alias("first"))
    if (1 << (4 * bits)) * salts <= 1 << 20:
        firsts = F.broadcast(firsts)  # at most cells x salts rows of 28 bytes, by these parameters
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = placed.select("doc_id", "curve", "salt", (F.octet_length(text).cast("long") + 16).alias("size"),
                         F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    bucket = Window.partitionBy("curve", "salt").orderBy("doc_id", "text_crc32", "size")
    rank = F.col("first") + F.row_number().over(bucket) - 1
    ranked = rows.join(firsts, ["curve", "salt"]).withColumn("rank", rank)
    shard = F.expr(f"rank * {shards} div total")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write `docs` as one folder per shard, joined to its place by id and text."""
    places = assign_shards(docs, shards).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard",
                                                "slot").dropDuplicates(["_id", "_crc"])
    key = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    joined = docs.join(places, docs["doc_id"].eqNullSafe(places["_id"]) & (key == places["_crc"])).drop("_id", "_crc")
    joined.repartition("shard", F.pmod("slot", F.lit(8))).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
