"""Sharding along a Hilbert curve (DataFrame functions only).

Metadata columns are quantised to a small grid by approximate quantiles, a row's cell is its place
on the Hilbert curve through that grid, and runs of the curve are cut into shards of nearly equal
bytes. Neighbours on the curve are alike in every dimension at once, so a reader that filters on any
of them can skip most shards by their minima and maxima.

Scale: only ids, sizes and cells are shuffled, and texts just where whole rows are wanted. Rows are
grouped into blocks ``(cell, part)`` by a hash of their text; a cell that holds a third of all rows is
divided into as many parts as its rows need, and a text that fills more than a block is spread over
several. Prefix sums are taken over block totals first (at most ``2 ** (bits * dims)`` cells, then the
parts of one cell), and only then inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import spread, written

#: Rows that one block holds on average at most.
BLOCK_ROWS = 50_000
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def _rotl(x: int, k: int, n: int) -> int:
    k %= n
    return ((x << k) | (x >> (n - k))) & ((1 << n) - 1)


def curve_table(dims: int) -> list[list[tuple[int, int]]]:
    """The curve as an automaton: ``table[state][corner] = (digit, next state)``.

    A state is an entry corner and a direction; the corner of a cell, one bit of each dimension, is
    brought into the state's frame, and its rank in Gray code is the next digit of the index."""
    n, size = dims, 1 << dims

    def entry(i: int) -> int:
        j = 2 * ((i - 1) // 2)
        return 0 if i == 0 else j ^ (j >> 1)

    def direction(i: int) -> int:
        trailing = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  ones at the low end
        return 0 if i == 0 else (trailing(i - 1) if i % 2 == 0 else trailing(i)) % n

    rank = {i ^ (i >> 1): i for i in range(size)}
    table = []
    for e in range(size):
        for d in range(n):
            row = []
            for corner in range(size):
                w = rank[_rotl(corner ^ e, n - (d + 1) % n, n)]
                row.append((w, (e ^ _rotl(entry(w), d + 1, n)) * n + (d + direction(w) + 1) % n))
            table.append(row)
    return table


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the curve of the cell with these coordinates (each ``0 .. 2 ** bits - 1``)."""
    n, table = len(cells), curve_table(len(cells))
    digits = F.array(*[F.lit(w) for row in table for w, _ in row])
    states = F.array(*[F.lit(s) for row in table for _, s in row])

    def corner(level: Column) -> Column:
        total = F.lit(0)
        for axis, cell in enumerate(cells):
            total = total + F.expr("cast(1 as int)") * ((cell / F.pow(F.lit(2.0), level)).cast("int") % 2) * (1 << axis)
        return total

    def step(acc: Column, level: Column) -> Column:
        at = acc["s"] * F.lit(1 << n) + corner(level)
        return F.struct(F.get(states, at).alias("s"), (acc["h"] * F.lit(1 << n) + F.get(digits, at).cast("long")).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), start, step)["h"]


def cuts_of(docs: DataFrame, column: str, kind: str, bits: int) -> list:
    """Values at which the cells of a dimension begin, at most ``2 ** bits - 1``.

    Numbers are cut at approximate quantiles, strings at those of their distinct values, counted and
    added up in the order of the strings themselves, range by range."""
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    if kind != "string":
        return sorted(set(docs.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), share, 10_000)).first()[0] or []))
    counts = docs.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    counts = written(written(counts, "shards-values").repartitionByRange("v").withColumn("part", F.spark_partition_id()), "shards-ranges")
    sums = counts.groupBy("part").agg(F.sum("n").alias("p"))  # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("before"), F.sum("p").over(Window.partitionBy(F.lit(0))).alias("total"))
    run = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(sums), "part").withColumn("stop", F.col("before") + F.sum("n").over(run))
    cell = lambda x: F.floor(x * (1 << bits) / F.col("total"))
    # a cell begins with the value behind the first that reaches its share
    firsts = placed.where(cell(F.col("stop") - F.col("n")) < cell(F.col("stop"))).select("v")
    return sorted(r["v"] for r in firsts.collect())


def shard_hilbert(
    docs: DataFrame,
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    shards: int = 40,
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
    whole: bool = False,
) -> DataFrame:
    """One row per document: ``id_col``, size, text_crc32, cell (curve index), shard, slot; with
    ``whole`` behind the columns of ``docs`` themselves, of which those with these names give way.

    Shards hold nearly equal bytes: a document goes where the middle of its bytes falls, so a shard
    is off its share by less than the largest document. A null text is of size 16 with crc32 null; a
    null coordinate is in cell 0. Rows of a cell are ordered by a hash of their text, then by id, so
    equal texts of a cell part only where a cut falls between them; repeated rows are alike and take
    neighbouring slots. Long texts count whole. An empty table gives no rows."""
    kinds = dict(docs.dtypes)
    cuts = [cuts_of(docs, d, kinds[d], bits) for d in dims]  # only metadata is read for the quantiles

    def cell(i: int) -> Column:
        if not cuts[i]:
            return F.lit(0)
        value = F.col(f"`{dims[i]}`") if kinds[dims[i]] == "string" else F.col(f"`{dims[i]}`").cast("double")
        over = (lambda x: x < value) if kinds[dims[i]] == "string" else (lambda x: x <= value)
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts[i]]), over)), F.lit(0))

    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(text, F.lit("\u0000null"))).alias("tie"),
        *[F.when(F.col(f"`{d}`").isNull(), 0).otherwise(cell(i)).alias(f"c{i}") for i, d in enumerate(dims)],
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    base = base.withColumn("cell", hilbert_index([F.col(f"c{i}") for i in range(len(dims))], bits)).withColumn("uid", F.monotonically_increasing_id())
    base = base.select("row", "id", "size", "crc", "cell", "tie", "uid")
    # texts are read once for all but the rows themselves
    slim = written(base if whole else base.drop("row"), "shards")
    parts = max(1, -(-slim.count() // block_rows))
    # the part follows the order of the tie, so blocks are runs of one total order
    slim = slim.withColumn("part", F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * parts).cast("long"))
    slim = spread(slim, ["cell"], "part", "tie", "uid", block_rows)
    block = ["cell", "part", "hot", "sub"]
    blocks = slim.groupBy(*block).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    cells = blocks.groupBy("cell").agg(F.sum("b").alias("cb"), F.sum("r").alias("cr"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** (bits * dims) rows
    everything = Window.partitionBy(F.lit(0))
    zero = F.lit(0).cast("long")
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("cb").over(before), zero).alias("cell_b"),
        F.coalesce(F.sum("cr").over(before), zero).alias("cell_r"),
        F.sum("cb").over(everything).alias("all_b"),
    )
    inside = Window.partitionBy("cell").orderBy("part", F.asc_nulls_first("hot"), "sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(cells, "cell").select(
        *block,
        "all_b",
        (F.col("cell_b") + F.coalesce(F.sum("b").over(inside), zero)).alias("off_b"),
        (F.col("cell_r") + F.coalesce(F.sum("r").over(inside), zero)).alias("off_r"),
    )
    blocks = blocks.select(*[F.col(c).alias(f"o_{c}") for c in block], "all_b", "off_b", "off_r")
    run = Window.partitionBy(*block).orderBy("tie", "id", "uid")
    # twice the middle of the row's bytes, in whole numbers
    middle = 2 * (F.col("off_b") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")

    same = F.lit(True)
    for c in block:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))

    def placed(keep: list[str]) -> DataFrame:
        at = slim.join(blocks.hint("shuffle_hash"), same).select(*keep, "id", "size", "crc", "cell", (F.col("off_r") + F.row_number().over(run) - 1).alias("rank"), middle.alias("middle"), "all_b")
        return at.select(*keep, "id", "size", "crc", "cell", "rank", F.least(F.lit(shards - 1), F.expr(f"cast((middle * {shards}) div (2 * all_b) as int)")).alias("shard"))

    firsts = placed([]).groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    out = placed(["row"] if whole else []).join(F.broadcast(firsts), "shard")
    made = {"size": F.col("size"), "text_crc32": F.col("crc"), "cell": F.col("cell"), "shard": F.col("shard"), "slot": F.col("rank") - F.col("first")}
    if not whole:
        return out.select(F.col("id").alias(id_col), *[c.alias(n) for n, c in made.items()])
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return out.select(*kept, *[c.alias(n) for n, c in made.items()])
