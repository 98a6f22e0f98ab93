"""Entity-attribute-value rows as wide rows with typed columns.

Defined results. Rows with a null entity, attribute or value are left out by the caller's filter. Of several rows of one cell the
one with the largest order value counts. A value that its column's type can't take gives null. Attributes without rows give null
columns. An entity appears if any of its rows holds a value. An empty table gives an empty wide table with all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranks import dense_ranks
from gridloom.runtime import checked_broadcast, cut

#: Attributes per block of the grid. A block is one shuffled array, so that no row holds more than this many cells at once.
BLOCK = 64


def attribute_positions(cells: DataFrame, attribute: str) -> DataFrame:
    """Each distinct attribute with its position (0-based, in order of name); as a written table."""
    return cut(dense_ranks(cells.filter(F.col(attribute).isNotNull()), [attribute], "position"), "positions")


def attribute_grid(rows: DataFrame, entity: str, attribute: str, value: str, order: str, positions: DataFrame) -> DataFrame:
    """The grid by blocks: entity, block, cells (array of BLOCK strings, sorted by attribute position; null: no value).

    Cells are aggregated first, so a hot entity or attribute shuffles one row per cell. The cells of a block are collected, sorted by
    attribute position, and each position of the block takes its value from them or null: a left join of the positions to the values, within the
    row. Blocks that an entity doesn't touch are neither shuffled nor made.
    """
    cells = rows.groupBy(entity, attribute).agg(F.max_by(value, order).alias("__gl_v"))
    # Distinct attributes; broadcast only where a count proves them few.
    at = cells.join(checked_broadcast(positions), attribute, "left").filter("position is not null")
    cell = F.struct((F.col("position") % BLOCK).cast("int").alias("i"), F.col("__gl_v").alias("v"))
    held = at.groupBy(entity, F.floor(F.col("position") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("__gl_cells"))
    return held.select(entity, "block", _complete(F.col("__gl_cells"), "i", "v", BLOCK).alias("cells"))


def complete_rows(grid: DataFrame, entity: str, blocks: int) -> DataFrame:
    """The completed grid, one row per entity: ``blocks``, the array of all blocks below ``blocks``. A block without any value stands in
    its place as one null, which is read as null cells. The work is entities x blocks, so this is for as many blocks as a plan's columns
    need and never for as many as the attributes of a growing table have."""
    held = grid.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("block", "cells"))).alias("__gl_blocks"))
    return held.select(entity, _complete(F.filter("__gl_blocks", lambda b: b.block < blocks), "block", "cells", blocks).alias("blocks"))


def _complete(held: Column, place: str, value: str, size: int) -> Column:
    """The values of an array sorted by ``place``, each at its place, with a null at each place below ``size`` that has none."""
    nulls = lambda n: F.array_repeat(F.when(F.lit(False), F.get(held, F.lit(0))[value]), n)
    before = lambda k: F.coalesce(F.get(held, k - 1)[place], F.lit(-1))
    last = F.coalesce(F.get(held, F.size(held) - 1)[place], F.lit(-1))
    filled = F.flatten(F.transform(held, lambda x, k: F.concat(nulls(x[place] - before(k) - 1), F.array(x[value]))))
    return F.concat(filled, nulls(F.lit(size - 1) - last))


def wide_table(grid: DataFrame, entity: str, columns: list[tuple[str, int | None, str]]) -> DataFrame:
    """One row per entity: for each (name, position, type) the cell at its fixed index, through a try cast to its type. A column
    without a position (no row has its attribute) is null. Rows are completed over the blocks that hold a named column, in order."""
    needed = {b: i for i, b in enumerate(sorted({p // BLOCK for _, p, _ in columns if p is not None}))}
    places = grid.sparkSession.createDataFrame([*needed.items()], "block int, __gl_place int")  # at most one row per column
    placed = grid.join(F.broadcast(places), "block", "left")
    rows = complete_rows(placed.select(entity, F.col("__gl_place").alias("block"), F.when(F.col("__gl_place").isNotNull(), F.col("cells")).alias("cells")), entity, max(1, len(needed)))
    cell = lambda p: F.get(F.get("blocks", F.lit(needed[p // BLOCK])), F.lit(p % BLOCK))
    return rows.select(entity, *[(cell(p) if p is not None else F.lit(None).cast("string")).try_cast(t).alias(n) for n, p, t in columns])


def unpivot_grid(grid: DataFrame, entity: str, attribute: str, positions: DataFrame, kind: str = "double") -> DataFrame:
    """The cells of all attributes that ``kind`` can hold, as entity, attribute and value, read from the completed blocks.

    Each block of a row is projected to BLOCK typed columns by fixed indices, as ``wide_table`` projects the columns it is given by name,
    and the typed columns are stacked. This reads a table of more columns than a plan can name. A block that an entity doesn't touch
    holds nothing but nulls, which stacking leaves out; it is not made for that, so the work follows the cells and not entities x blocks.
    """
    typed = grid.select(entity, F.col("block").alias("__gl_block"), *[F.get("cells", F.lit(i)).try_cast(kind).alias(f"__gl_{i}") for i in range(BLOCK)])
    long = typed.select(entity, "__gl_block", F.posexplode(F.array(*[f"__gl_{i}" for i in range(BLOCK)])).alias("__gl_i", "value")).filter("value is not null")
    long = long.select(entity, (F.col("__gl_block").cast("bigint") * BLOCK + F.col("__gl_i")).alias("position"), "value")
    return long.join(checked_broadcast(positions), "position").select(entity, attribute, "value")
