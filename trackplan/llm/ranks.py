"""Row numbers over large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Scratch

#: Cells that a group's rows are spread over by their order.
CELLS = 4096
#: Rows of a cell that one task sorts; a cell of more is dealt into parts by a hash of `id`.
MOST_ROWS = 1 << 20
#: Rows of the table of such cells that are broadcast at most; it is joined by shuffling beyond that.
MOST_BROADCAST = 100_000


def numbered(scratch: Scratch, rows: DataFrame, group: list[str], order: list[Column], cell: Column, name: str, most: int = MOST_ROWS) -> DataFrame:
    """Add `name`: 0, 1, ... within each group, by cell, part and then `order`.

    cell: int Column that rises with the order wanted (for instance the top bits
    of a hash); each (group, cell) is sorted on its own, cells are then offset
    by the counts before them.  However many rows share a cell (a null or
    repeated key), a task sorts about `most` of them: within such a cell the
    parts come before the order.  `rows` has a column id; rows with equal ids
    are interchangeable.  It is read several times: give a table.
    """

    def same(table: DataFrame, more: list[str]) -> Column:
        every = [(g, f"_g{i}") for i, g in enumerate(group)] + [(c, f"{c}_") for c in more]
        on = F.lit(True)
        for a, b in every:
            on &= F.col(a).eqNullSafe(table[b])
        return on

    rows = rows.withColumn("_cell", cell)
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    renamed = [f"_g{i}" for i in range(len(group))]
    sizes = scratch.store(rows.groupBy(*keys, F.col("_cell").alias("_cell_")).agg(F.count("*").alias("_n")), "cells")
    large = sizes.where(F.col("_n") > most).withColumn("_parts", F.ceil(F.col("_n") / most).cast("long")).drop("_n")
    several = large.count()
    part = F.lit(0).cast("long")
    if several:
        large = scratch.store(large, "large-cells", keep=True)
        rows = rows.join(F.broadcast(large) if several <= MOST_BROADCAST else large, same(large, ["_cell"]), "left").drop("_cell_", *renamed)
        part = F.pmod(F.xxhash64("id", F.lit(13)), F.coalesce("_parts", F.lit(1)))
    rows = rows.withColumn("_part", part).drop("_parts")
    if several:
        sizes = rows.groupBy(*keys, F.col("_cell").alias("_cell_"), F.col("_part").alias("_part_")).agg(F.count("*").alias("_n"))
    else:
        sizes = sizes.withColumn("_part_", F.lit(0).cast("long"))
    before = W.partitionBy(*renamed).orderBy("_cell_", "_part_").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*renamed, "_cell_", "_part_", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    starts = scratch.store(starts, "starts", keep=True)
    inside = F.row_number().over(W.partitionBy(*group, "_cell", "_part").orderBy(*order, "id"))
    out = rows.withColumn("_in", inside).join(starts, same(starts, ["_cell", "_part"]))
    return out.withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_cell", "_part", "_cell_", "_part_", "_before", "_in", *renamed)
