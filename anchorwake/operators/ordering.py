"""Ordered work on partitions of any size.

Most keys (games) are small and are handled by a plain window over the key. A
key may also hold a large share of all rows; a window over it would put them in
one task. Such a key is cut into blocks of consecutive rows. The cut points come
from a sample of the sort key chosen by hash, so they are the same in every
evaluation, and a row finds its block by binary search among them. Windows then run per
(key, block), and what crosses a block boundary is passed on through a table
with one row per block. The number of blocks is at most about twice MAX_BLOCKS
whatever the size of the data, so that table may be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorwake.sources.settle import settle

BLOCK = "_block"
ROWS_PER_BLOCK = 250_000
ROWS_PER_BLOCK_CONF = "spark.anchorwake.rowsPerBlock"
MAX_BLOCKS = 65_536
SAMPLES_PER_BLOCK = 16
#: Sampled rows of one key that are sorted in one group.
GATHERED_SAMPLES = 16_384


def rows_per_block(spark: SparkSession) -> int:
    """Rows that one task may hold in order; settable per session."""
    return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(ROWS_PER_BLOCK)))


def sort_key(order: Sequence[str]) -> Column:
    """One comparable value for the order columns, missing values last."""
    return F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])


@dataclass(frozen=True)
class Split:
    """Cut points of the large keys: one row per key with a sorted array."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bounds: DataFrame
    search_steps: int

    def assign(self, df: DataFrame, large_only: bool = False) -> DataFrame:
        """Add the block number: 0 for whole keys, 1.. in order for cut ones."""
        how = "inner" if large_only else "left"
        rows = df.join(F.broadcast(self.bounds), list(self.keys), how)
        rows = rows.withColumns({"_key": sort_key(self.order), "_passed": F.lit(0)})
        # Binary search, one compiled step per power of two. Past the end of the
        # array a probe is null and the step is not taken.
        passed = F.col("_passed")
        for bit in range(self.search_steps - 1, -1, -1):
            step = 2**bit
            probe = F.get("_cuts", passed + (step - 1))
            rows = rows.withColumn(
                "_passed", F.when(probe <= F.col("_key"), passed + step).otherwise(passed)
            )
        block = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(passed + 1)
        return rows.withColumn(BLOCK, block).drop("_cuts", "_key", "_passed")

    def blocks(self) -> DataFrame:
        """Every block of the cut keys, one row each."""
        numbers = F.sequence(F.lit(1), F.size("_cuts") + 1)
        return self.bounds.select(*self.keys, F.explode(numbers).alias(BLOCK))


def key_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of every key, materialised: (keys, _rows)."""
    return settle(df.groupBy(*keys).agg(F.count("*").alias("_rows")))


def find_split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: int | None = None,
    sizes: DataFrame | None = None,
) -> Split | None:
    """Cut points for the keys with more rows than ``limit``, None if there are none.

    The check is one aggregate over the key column, or over ``sizes`` where those are
    known; only two numbers come back. The cut points are materialised, as every use of
    them would scan ``df`` again.
    """
    limit = limit or rows_per_block(df.sparkSession)
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    size = max(limit, math.ceil((total or 0) / MAX_BLOCKS))
    if largest is None or largest <= size:
        return None
    every = max(1, size // SAMPLES_PER_BLOCK)
    large = sizes.where(F.col("_rows") > size).select(*keys)  # fewer than MAX_BLOCKS keys
    chosen = F.xxhash64(*order)
    sample = (
        df.select(*keys, *order)
        .where(F.pmod(chosen, F.lit(every)) == 0)
        .join(F.broadcast(large), list(keys))
    )
    # Twice the expected number of cuts; any beyond would only make the last block larger.
    search_steps = (2 * math.ceil(largest / size)).bit_length()
    if largest // every > GATHERED_SAMPLES:
        sample, cuts = _cuts_in_ranges(settle(sample), keys, order, every, largest)
    else:
        cuts = F.filter(
            F.sort_array(F.collect_list(sort_key(order))),
            lambda _, i: i % SAMPLES_PER_BLOCK == SAMPLES_PER_BLOCK - 1,
        )
    bounds = sample.groupBy(*keys).agg(cuts.alias("_cuts"))
    return Split(tuple(keys), tuple(order), settle(bounds), search_steps)


def _cuts_in_ranges(
    sample: DataFrame, keys: Sequence[str], order: Sequence[str], every: int, largest: int
) -> tuple[DataFrame, Column]:
    """The same cut points without gathering the sample of a key.

    A sample of the sample divides it into ranges; each range is sorted for itself, and the
    counts of the ranges before give the place of its rows. Only the cut points of a
    key come together, which every task needs anyway.
    """
    per_range = GATHERED_SAMPLES // SAMPLES_PER_BLOCK
    fewer = sample.where(F.pmod(F.xxhash64(*order), F.lit(every * per_range)) == 0)
    ranges = fewer.groupBy(*keys).agg(F.sort_array(F.collect_list(sort_key(order))).alias("_cuts"))
    coarse = Split(tuple(keys), tuple(order), settle(ranges), (2 * math.ceil(largest / every / per_range)).bit_length())
    placed = coarse.assign(sample)
    in_key = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*keys, BLOCK).agg(F.count("*").alias("_rows"))
    before = settle(before.withColumn("_skip", F.coalesce(F.sum("_rows").over(in_key), F.lit(0))).drop("_rows"))
    by = [F.col(c).asc_nulls_last() for c in order]
    at = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*by)) + F.col("_skip")
    cut = placed.join(F.broadcast(before), [*keys, BLOCK]).withColumn("_at", at).where(F.col("_at") % SAMPLES_PER_BLOCK == 0)
    return cut, F.sort_array(F.collect_list(sort_key(order)))


def fits_one_block(df: DataFrame) -> bool:
    """Whether one task may hold the whole table in order."""
    return df.count() <= rows_per_block(df.sparkSession)


def with_positions(df: DataFrame, order: Sequence[str], fits: bool | None = None) -> tuple[DataFrame, bool]:
    """Add ``_position``, the 0-based place of each row in the total order.

    Read ``df`` from a materialised table: it is scanned more than once. The
    flag tells whether the table was cut into blocks (``_block``). ``fits`` is the
    result of ``fits_one_block`` where the caller has it.
    """
    whole = df.withColumn("_whole", F.lit(0))
    split = None if fits else find_split(whole, ("_whole",), order)
    by = [F.col(c).asc_nulls_last() for c in order]
    if split is None:  # checked: the whole table fits one block
        return df.withColumn("_position", F.row_number().over(Window.orderBy(*by)) - F.lit(1)), False
    blocked = split.assign(whole).drop("_whole")
    rows = blocked.withColumn(
        "_place", F.row_number().over(Window.partitionBy(BLOCK).orderBy(*by)).cast("bigint")
    )
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(BLOCK)
        .agg(F.count("*").alias("_rows"))
        .select(BLOCK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_skip"))
    )
    placed = rows.join(F.broadcast(starts), BLOCK)
    return placed.withColumn("_position", F.col("_skip") + F.col("_place") - 1).drop(
        "_skip", "_place"
    ), True


def with_average_rank(
    df: DataFrame, value: str, tie_break: str, name: str, fits: bool | None = None
) -> DataFrame:
    """Add the 1-based rank of ``value``; equal values share their mean rank.

    Read ``df`` from a materialised table. A table that had to be cut is
    materialised again, as the next step would repeat several scans of it.
    """
    ranked, cut = with_positions(df, (value, tie_break), fits)
    ties = Window.partitionBy(BLOCK, value) if cut else Window.partitionBy(value)
    ranked = ranked.withColumns(
        {"_first": F.min("_position").over(ties), "_last": F.max("_position").over(ties)}
    )
    if cut:
        # Values that continue over a block boundary: fewer than there are blocks.
        spans = (
            ranked.groupBy(value)
            .agg(
                F.min("_position").alias("_from"),
                F.max("_position").alias("_to"),
                F.count_distinct(BLOCK).alias("_blocks"),
            )
            .where("_blocks > 1")
            .drop("_blocks")
        )
        ranked = ranked.join(F.broadcast(spans), value, "left").withColumns(
            {
                "_first": F.coalesce("_from", "_first"),
                "_last": F.coalesce("_to", "_last"),
            }
        )
    rank = (F.col("_first") + F.col("_last")) / 2 + 1
    ranked = ranked.withColumn(name, rank).select(*df.columns, name)
    return settle(ranked) if cut else ranked


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], tie_break: str) -> DataFrame:
    """One row of exact, linearly interpolated quantiles; missing values are skipped.

    Read ``df`` from a materialised table. If it has more rows than a block, its values are
    counted in bins, for all quantiles in one scan; only the bins that hold a wanted place are sorted.
    """
    if fits_one_block(df):
        return df.agg(*[F.percentile(x, F.lit(q)).alias(name) for name, (x, q) in wanted.items()])
    kinds = list(dict.fromkeys(str(x) for x, _ in wanted.values()))
    columns = {str(x): x for x, _ in wanted.values()}
    each = F.array(*[F.struct(F.lit(i).alias("_kind"), columns[k].cast("double").alias("_x")) for i, k in enumerate(kinds)])
    values = df.select(F.inline(each), F.col(tie_break).alias("_tie")).where("_x IS NOT NULL")
    order = ("_x", "_tie")
    split = find_split(values, ("_kind",), order)
    binned = values.withColumn(BLOCK, F.lit(0)) if split is None else split.assign(values)
    counts = settle(binned.groupBy("_kind", BLOCK).agg(F.count("*").alias("_rows")))
    in_kind = Window.partitionBy("_kind").orderBy(BLOCK)
    bins = counts.withColumn("_end", F.sum("_rows").over(in_kind)).withColumn("_skip", F.col("_end") - F.col("_rows"))
    totals = {r["_kind"]: r["n"] for r in counts.groupBy("_kind").agg(F.sum("_rows").alias("n")).collect()}
    places = []  # name, kind, 0-based place below, share of the way to the place above
    for name, (x, q) in wanted.items():
        kind = kinds.index(str(x))
        at = max(totals.get(kind, 0) - 1, 0) * q
        places += [(name, kind, place, at - math.floor(at)) for place in sorted({math.floor(at), math.ceil(at)})]
    asked = df.sparkSession.createDataFrame(places, "_name string, _kind int, _place bigint, _part double")
    # One or two rows per quantile, each with the bin that holds its place.
    held = F.broadcast(asked).join(bins, "_kind").where("_skip <= _place AND _place < _end")
    sorted_bins = binned.join(F.broadcast(held.select("_kind", BLOCK, "_skip").distinct()), ["_kind", BLOCK])
    by = [F.col(c).asc_nulls_last() for c in order]
    at = F.row_number().over(Window.partitionBy("_kind", BLOCK).orderBy(*by)) + F.col("_skip") - 1
    found = sorted_bins.select("_kind", "_x", at.alias("_place")).join(F.broadcast(asked), ["_kind", "_place"])
    ends = found.groupBy("_name").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.any_value("_part").alias("_part"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")
    return ends.agg(*[F.max(F.when(F.col("_name") == name, value)).alias(name) for name in wanted])


def starts_by_key(sizes: DataFrame, *keys: str) -> DataFrame:
    """Rows before each key in key order, (keys, _start), from the rows of each key.

    Keys may have any type that sorts. ``sizes`` is read more than once, so pass a
    materialised table (``key_sizes``). If it has more rows than a block, the prefix sums
    run per block of consecutive keys and then over the blocks.
    """
    sizes = sizes.dropna(subset=list(keys))
    whole = sizes.withColumn("_whole", F.lit(0))
    split = find_split(whole, ("_whole",), keys)
    before = (Window.unboundedPreceding, -1)
    if split is None:  # checked: all keys fit one block
        start = F.sum("_rows").over(Window.orderBy(*keys).rowsBetween(*before))
        return sizes.select(*keys, F.coalesce(start, F.lit(0)).alias("_start"))
    blocked = split.assign(whole).drop("_whole")
    inside = F.sum("_rows").over(Window.partitionBy(BLOCK).orderBy(*keys).rowsBetween(*before))
    skips = (
        blocked.groupBy(BLOCK)
        .agg(F.sum("_rows").alias("_rows"))
        .select(BLOCK, F.coalesce(F.sum("_rows").over(Window.orderBy(BLOCK).rowsBetween(*before)), F.lit(0)).alias("_skip"))
    )
    placed = blocked.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(skips), BLOCK)
    return placed.select(*keys, (F.col("_skip") + F.col("_inside")).alias("_start"))
