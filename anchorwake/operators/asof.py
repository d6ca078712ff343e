"""As-of join: each row of one table with the latest row of another that is not later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.operators.ordering import BLOCK, find_split, sort_key
from anchorwake.sources.settle import settle

_SIDE, _FOUND, _TIE = "_of_left", "_latest", "_row_hash"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    order: Sequence[str],
    values: Sequence[str] | None = None,
    how: str = "left",
    prefix: str = "",
    split="find",
) -> DataFrame:
    """``left`` with the columns ``values`` of the latest row of ``right`` that has the same keys.

    Rows are compared by the columns ``order``, which both tables have; an equal row counts as not later. Of
    several right rows with the same keys and order the one with the largest values counts, so the result
    does not depend on how the tables are dealt out. A left row with a missing key or place in the order finds
    nothing, and such a right row is not found. ``values`` are by default all other columns of
    ``right``; ``prefix`` is put before their names. ``how="inner"`` leaves out rows that
    find nothing.

    The two tables are united and shuffled once, by the keys; the latest right row is then carried
    forward in order, so neither table is ever joined row by row. Keys with more rows than a block
    are cut as in ``ordering``, and the last right row of each block goes on to the next.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    on, order = list(on), list(order)
    values = [c for c in right.columns if c not in (*on, *order)] if values is None else list(values)
    names = [f"{prefix}{v}" for v in values]
    clashing = sorted({*names} & {*left.columns})
    if clashing:
        raise ValueError(f"both tables have {', '.join(clashing)}: choose a prefix")
    placed = [*on, *order]
    known = F.lit(True)
    for column in placed:
        known = known & F.col(column).isNotNull()
    ours = left.where(known).withColumns({_SIDE: F.lit(1), _TIE: F.xxhash64(*left.columns)})
    theirs = right.where(known).select(*placed, F.struct(*[F.col(v).alias(n) for v, n in zip(values, names, strict=True)]).alias(_FOUND))
    rows = ours.unionByName(theirs.withColumn(_SIDE, F.lit(0)), allowMissingColumns=True)
    # Right rows before left rows of the same place; the last columns let ties be cut as well.
    full = [*order, _SIDE, _FOUND, _TIE]
    if split == "find":
        split = find_split(rows, on, full)
    rows = rows if split is None else split.assign(rows)
    keys = on if split is None else [*on, BLOCK]
    so_far = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in full])
    latest = F.last(_FOUND, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = rows.withColumn("_carried", latest).where(F.col(_SIDE) == 1)
    if split is not None:
        last = split.assign(rows.drop(BLOCK), large_only=True).where(F.col(_SIDE) == 0).groupBy(*on, BLOCK)
        tails = settle(last.agg(F.max_by(_FOUND, sort_key(full)).alias("_tail")))
        earlier = Window.partitionBy(*on).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        # One row per block; those without a right row pass on what they were given.
        every = split.blocks().join(tails, [*on, BLOCK], "left")
        given = settle(every.select(*on, BLOCK, F.last("_tail", ignorenulls=True).over(earlier).alias("_given")))
        filled = filled.join(F.broadcast(given), [*on, BLOCK], "left").withColumn("_carried", F.coalesce("_carried", "_given"))
    if how == "inner":
        filled = filled.where("_carried IS NOT NULL")
    found = filled.select(*left.columns, *[F.col("_carried")[n].alias(n) for n in names])
    if how == "inner":
        return found
    kinds = {f.name: f.dataType for f in right.schema.fields}
    nothing = [F.lit(None).cast(kinds[v]).alias(n) for v, n in zip(values, names, strict=True)]
    return found.unionByName(left.where(~known).select(*left.columns, *nothing))
