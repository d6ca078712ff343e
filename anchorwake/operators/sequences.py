"""Anchors and the events that follow them.

The log is ordered by (compiledgametime, row_pos) within a game. Operators that
need this order accept a ``split`` (see ``ordering``): ``"find"`` checks the size
of the games, ``None`` states that no game is too large for one task. The check
reads the game column of the table, so on a computed table pass the split of the
log it comes from. Results have the same columns and rows whatever the split; the
``_in_blocks`` forms keep the block number for the next operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from anchorwake.functions import fixed
from anchorwake.operators.ordering import (
    BLOCK,
    Split,
    find_split,
    key_sizes,
    sort_key,
    starts_by_key,
)
from anchorwake.sources.settle import settle

GAME = "gameid"
TIME = "compiledgametime"
ORDER = (TIME, "row_pos")


def is_anchor() -> Column:
    return F.coalesce(F.col("eventname") == fixed.ANCHOR_EVENT, F.lit(False))


def split_games(events: DataFrame, limit: int | None = None, sizes: DataFrame | None = None) -> Split | None:
    """Cut points for games that hold too many rows for one task."""
    return split_keys(events, (GAME,), ORDER, limit, sizes)


def split_keys(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None, sizes: DataFrame | None = None
) -> Split | None:
    """Cut points for keys that hold too many rows for one task. Rows without a key are not counted."""
    return find_split(events.dropna(subset=list(keys)), keys, order, limit, sizes)


def _blocked(df: DataFrame, split) -> DataFrame:
    if BLOCK in df.columns:
        return df
    split = split_games(df) if split == "find" else split
    return df if split is None else split.assign(df)


def _in_order(df: DataFrame, keys: Sequence[str] = (GAME,), order: Sequence[str] = ORDER) -> WindowSpec:
    keys = [*keys, BLOCK] if BLOCK in df.columns else keys
    return Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def _earlier_blocks(keys: Sequence[str] = (GAME,)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def attach_anchor(
    events: DataFrame,
    split="find",
    number: bool = True,
    *,
    keys: Sequence[str] = (GAME,),
    order: Sequence[str] = ORDER,
    anchor: Column | None = None,
    same: Sequence[str] = ("period",),
    fill: bool = True,
    prefix: str = "faceoff",
) -> DataFrame:
    """Give each event the id, time and context of the latest anchor of its keys.

    Anchors are the rows where ``anchor`` holds (faceoffs); a row is its own latest one. ``order`` sorts the rows of
    a key, missing values last, and its first column is the time. The context are the
    columns ``same``: a value that an anchor lacks is that of the anchor before, or missing with
    ``fill=False``. The added columns are ``<prefix>_sequence_id, <prefix>_time`` and one ``<prefix>_<column>`` for each of ``same``.

    The id is the anchor's 0-based place in the whole log by keys and order.
    ``number=False`` leaves the id out, which saves a pass. Rows
    with a missing key belong to no sequence and are left out.
    """
    return plain(attach_in_blocks(events, split, number, keys=keys, order=order, anchor=anchor, same=same, fill=fill, prefix=prefix))


def attach_in_blocks(
    events: DataFrame,
    split="find",
    number: bool = True,
    *,
    keys: Sequence[str] = (GAME,),
    order: Sequence[str] = ORDER,
    anchor: Column | None = None,
    same: Sequence[str] = ("period",),
    fill: bool = True,
    prefix: str = "faceoff",
) -> DataFrame:
    keys, order = list(keys), list(order)
    marked = is_anchor() if anchor is None else F.coalesce(anchor, F.lit(False))
    # What is carried, by name: a value that may be missing is held in a struct, which never is.
    names = {f"{prefix}_time": F.col(order[0])} | {f"{prefix}_{c}": F.col(c) if fill else F.struct(c) for c in same}
    events = events.dropna(subset=keys)
    sizes = key_sizes(events, keys) if number else None
    if split == "find":
        split = split_keys(events, keys, order, sizes=sizes)
    rows = events if split is None else split.assign(events)
    ordered = _in_order(rows, keys, order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def latest(value: Column) -> Column:
        return F.last(F.when(marked, value), ignorenulls=True).over(so_far)

    rows = rows.withColumn("_at", F.row_number().over(ordered).cast("bigint"))
    rows = rows.withColumns({"_anchor_at": latest(F.col("_at"))} | {n: latest(x) for n, x in names.items()})
    cut = split is not None
    if cut:
        rows = _carry_anchor(rows, _tails(split, events, marked, names, number), keys, names)
    if number:
        starts = starts_by_key(sizes, *keys)
        if cut:
            whole = starts.withColumn(BLOCK, F.lit(0))
            starts = whole.unionByName(split.blocks().join(starts, keys))
        rows = rows.join(starts, [*keys, BLOCK] if cut else keys)
        rows = rows.withColumn(f"{prefix}_sequence_id", F.col("_start") + F.col("_anchor_at") - 1)
    if not fill:
        rows = rows.withColumns({f"{prefix}_{c}": F.col(f"{prefix}_{c}")[c] for c in same})
    added = [f"{prefix}_sequence_id"] if number else []
    block = [BLOCK] if cut else []
    return rows.select(*events.columns, *block, *added, *names)


def _tails(split: Split, events: DataFrame, marked: Column, names: dict[str, Column], number: bool) -> DataFrame:
    """Size and last anchor of each block of the cut keys, from grouped scans alone."""
    rows, key = split.assign(events, large_only=True), sort_key(split.order)
    by = [*split.keys, BLOCK]

    def last_known(value: Column) -> Column:
        return F.max_by(value, F.when(marked & value.isNotNull(), key))

    tails = rows.groupBy(*by).agg(
        F.count("*").alias("_rows"),
        F.max(F.when(marked, key)).alias("_last"),
        *[last_known(x).alias(f"_tail_{n}") for n, x in names.items()],
    )
    if not number:
        return tails.withColumn("_tail_at", F.lit(None).cast("bigint"))
    later = (
        rows.join(F.broadcast(tails.select(*by, "_last")), by)
        .groupBy(*by)
        .agg(F.count_if(key > F.col("_last")).alias("_later"))
    )
    at = F.when(F.col("_last").isNotNull(), F.col("_rows") - F.col("_later"))
    return tails.join(later, by).withColumn("_tail_at", at)


def _carry_anchor(rows: DataFrame, tails: DataFrame, keys: list[str], names: Iterable[str]) -> DataFrame:
    """Pass the latest anchor from block to block of the cut keys."""
    earlier = _earlier_blocks(keys)
    tails = settle(tails).withColumn("_skip", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))

    def before(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(earlier)

    carried = tails.select(
        *keys,
        BLOCK,
        "_skip",
        before(F.col("_skip") + F.col("_tail_at")).alias("_carry_at"),
        *[before(F.col(f"_tail_{n}")).alias(f"_carry_{n}") for n in names],
    )
    joined = rows.join(F.broadcast(carried), [*keys, BLOCK], "left")
    skipped = F.coalesce("_skip", F.lit(0))
    filled = {"_anchor_at": F.coalesce(skipped + F.col("_anchor_at"), "_carry_at")}
    filled |= {n: F.coalesce(n, f"_carry_{n}") for n in names}
    return joined.withColumns(filled).drop("_skip", "_carry_at", *[f"_carry_{n}" for n in names])


def window_after_anchor(
    attached: DataFrame,
    horizon: float = fixed.HORIZON_SECONDS,
    same: Sequence[str] = ("period",),
    *,
    missing_differs: bool = True,
    time: str = TIME,
    prefix: str = "faceoff",
) -> DataFrame:
    """Keep the events at most ``horizon`` after their anchor and with the same context.

    ``same`` are the columns whose value must be that of the anchor, as ``attach_anchor`` has
    added them with the same argument. A missing value differs from all, or with
    ``missing_differs=False`` only from those that are not missing.
    """
    kept = attached.where(F.col(time) <= F.col(f"{prefix}_time") + horizon)
    for name in same:
        ours, anchors = F.col(name), F.col(f"{prefix}_{name}")
        kept = kept.where(ours == anchors if missing_differs else ours.eqNullSafe(anchors))
    if f"{prefix}_sequence_id" in attached.columns:
        kept = kept.where(F.col(f"{prefix}_sequence_id").isNotNull())
    return kept.drop(*[f"{prefix}_{name}" for name in same])


def sequence_summary(windowed: DataFrame) -> DataFrame:
    """One row: events kept and distinct sequences."""
    return windowed.agg(
        F.count("*").alias("n_events"),
        F.count_distinct("faceoff_sequence_id").alias("n_sequences"),
    )


def anchor_sessions(windowed: DataFrame, split="find") -> DataFrame:
    """Number the physical anchors of each game from 1 and give the id to their events.

    A new one starts at an anchor whose time differs from that of the row before
    it, whatever that row is; the first anchor of a game always starts one. A missing
    time differs from no other.
    """
    return plain(sessions_in_blocks(windowed, split))


def sessions_in_blocks(windowed: DataFrame, split="find") -> DataFrame:
    rows = _blocked(windowed, split)
    ordered = _in_order(rows)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    differs = F.col(TIME) != F.lag(TIME).over(ordered)
    rows = rows.withColumn("_new", F.coalesce(is_anchor() & differs, F.lit(False)))
    rows = rows.withColumns(
        {
            "_inner": F.sum(F.col("_new").cast("bigint")).over(so_far),
            "_opens": F.first(is_anchor()).over(so_far),
        }
    )
    names = [*windowed.columns, *([BLOCK] if BLOCK in rows.columns and BLOCK not in windowed.columns else [])]
    own = F.col("_opens").cast("bigint") + F.col("_inner")
    numbered = rows.select(*names, own.cast("bigint").alias("physical_faceoff_id"))
    if BLOCK not in rows.columns:
        return numbered
    # The blocks of cut games are evaluated once: their summaries and their rows both come from there.
    cut = settle(rows.where(F.col(BLOCK) > 0))
    carried = settle(_carry_sessions(cut))
    joined = cut.join(F.broadcast(carried), [GAME, BLOCK])
    own = F.col("_base") + F.col("_first_opens").cast("bigint") + F.col("_inner")
    return numbered.where(F.col(BLOCK) == 0).unionByName(joined.select(*names, own.cast("bigint").alias("physical_faceoff_id")))


def _carry_sessions(rows: DataFrame) -> DataFrame:
    """Sessions started before each block of the cut games.

    A block is summed up by its first and last time, the sessions it starts and whether its
    first row may open one; two neighbours combine by comparing the times where they meet.
    """
    blocks = (
        rows.groupBy(GAME, BLOCK)
        .agg(
            F.max("_inner").alias("_started"),
            F.max("_opens").alias("_opens"),
            # Missing times are last: the first is missing if all are, the last if any is.
            F.min(TIME).alias("_head"),
            F.when(F.count(TIME) == F.count("*"), F.max(TIME)).alias("_tail"),
        )
    )
    in_game = Window.partitionBy(GAME).orderBy(BLOCK)
    differs = F.coalesce(F.lag("_tail").over(in_game) != F.col("_head"), F.lit(False))
    blocks = blocks.withColumn(
        "_first_opens", F.col("_opens") & (F.lag(BLOCK).over(in_game).isNull() | differs)
    )
    started = F.col("_started") + F.col("_first_opens").cast("bigint")
    return blocks.select(
        GAME,
        BLOCK,
        "_first_opens",
        F.coalesce(F.sum(started).over(_earlier_blocks()), F.lit(0)).alias("_base"),
    )


def plain(df: DataFrame) -> DataFrame:
    """Drop the block number."""
    return df.drop(BLOCK)
