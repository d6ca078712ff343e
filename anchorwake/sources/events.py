"""Read event logs and write the results."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorwake.functions.fixed import PANDAS_MISSING
from anchorwake.operators.ordering import BLOCK
from anchorwake.sources.csv_rows import ROW, SURPLUS, text_rows
from anchorwake.sources.schema import EVENTS, IDS, NEEDED, SEQUENCE, check_columns, complete

_KNOWN = {field.name: field.dataType for field in [*EVENTS.fields, *SEQUENCE.fields]}
_ID_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


def _kind(name: str, id_type: str) -> T.DataType | None:
    return _ID_TYPES[id_type] if name in IDS else _KNOWN.get(name)


def _number(text: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The value, and whether the text is one.

    Whole numbers may be written as decimals (``12.0``), but not with a fraction; NaN
    counts as missing. Only digits, signs, point and exponent make a number.
    """
    plain = F.trim(text)
    written = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    double = F.when(written, plain.try_cast("double"))
    if isinstance(kind, T.DoubleType):
        return double, double.isNotNull()
    exact = plain.try_cast(T.DecimalType(38, 6))
    value = F.coalesce(plain.try_cast(kind), F.when(exact == F.floor(exact), exact.try_cast(kind)))
    value = F.when(written, value)
    return value, value.isNotNull()


def _parsed(rows: DataFrame, blank_strings: str, id_type: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """The value of every column, and for the typed ones whether the text cannot be read."""
    if blank_strings not in ("missing", "keep"):
        raise ValueError("blank_strings is 'missing' or 'keep'")
    if id_type not in _ID_TYPES:
        raise ValueError(f"id_type is one of {', '.join(_ID_TYPES)}")
    values, unread = {}, {}
    for name in (c for c in rows.columns if c not in (SURPLUS, ROW)):
        kind, text = _kind(name, id_type), F.col(f"`{name}`")
        missing = text.isNull() | text.isin("", *PANDAS_MISSING)
        if kind is not None and not isinstance(kind, T.StringType):
            value, good = _number(text, kind)
            values[name] = F.when(~missing, value)
            unread[name] = ~missing & ~good
        elif blank_strings == "keep" and name not in IDS:
            kept = F.coalesce(text, F.lit(""))
            values[name] = F.when(kept != "NA", kept)
        else:
            values[name] = F.when(~missing, text)
    return values, unread


def read_events_csv(
    spark: SparkSession,
    path: str,
    blank_strings: str = "missing",
    id_type: str = "bigint",
    multi_line: bool = False,
    unreadable: str = "raise",
    required: Sequence[str] = NEEDED,
) -> DataFrame:
    """Read a CSV log with a header per file, add ``row_pos`` and keep unknown columns as text.

    The files of a folder may have their columns in different orders, and further columns
    of their own; a file without one of the ``required`` columns raises an error.
    ``blank_strings="missing"`` reads the usual missing-value texts as missing.
    ``"keep"`` treats only ``NA`` so and keeps a blank text as an empty one, which
    is how the reporting jobs read their input. ``id_type`` is the type of games, teams
    and players. ``multi_line`` allows line breaks in quoted fields, in files of any size.
    Rows with surplus fields or with a value that cannot be read raise an
    error, or are left to ``rejected_events_csv`` with ``unreadable="skip"``. A row
    with fewer fields than the header is accepted and filled up with missing values, as pandas and R do.
    """
    if unreadable not in ("raise", "skip"):
        raise ValueError("unreadable is 'raise' or 'skip'")
    rows = text_rows(spark, path, multi_line, required)
    values, unread = _parsed(rows, blank_strings, id_type)
    if unreadable == "skip":
        rows = rows.where(_reason(unread).isNull())
    else:
        for name in unread:
            message = F.concat(F.lit(f"{path}: cannot read {name}: "), F.col(f"`{name}`"))
            values[name] = F.when(unread[name], F.raise_error(message)).otherwise(values[name])
        # In the row's order, so that no choice of columns leaves it out with the rows.
        surplus = F.raise_error(F.concat(F.lit(f"{path}: a row has more fields than the header: "), F.col(SURPLUS)))
        rows = rows.where(F.when(F.col(SURPLUS).isNotNull(), surplus.cast("boolean")).otherwise(True))
    return rows.select(*[v.alias(n) for n, v in values.items()], ROW)


def rejected_events_csv(
    spark: SparkSession,
    path: str,
    blank_strings: str = "missing",
    id_type: str = "bigint",
    multi_line: bool = False,
    required: Sequence[str] = NEEDED,
) -> DataFrame:
    """The rows that ``read_events_csv`` cannot read, as text, with ``reason``."""
    rows = text_rows(spark, path, multi_line, required)
    _, unread = _parsed(rows, blank_strings, id_type)
    return rows.withColumn("reason", _reason(unread)).where("reason IS NOT NULL").drop(SURPLUS)


def _reason(unread: dict[str, Column]) -> Column:
    """Why a row is not accepted; null if it is."""
    reason = F.when(F.col(SURPLUS).isNotNull(), "surplus fields")
    for name, bad in unread.items():
        reason = reason.when(bad, f"cannot read {name}")
    return reason


class SplitLog(NamedTuple):
    """The rows that a check has accepted, and the others with the reason."""

    accepted: DataFrame
    rejected: DataFrame


def store_events_csv(
    spark: SparkSession,
    path: str,
    out: str,
    blank_strings: str = "missing",
    id_type: str = "bigint",
    multi_line: bool = False,
    required: Sequence[str] = NEEDED,
    mode: str = "error",
) -> SplitLog:
    """Read a CSV log once and store it as Parquet under ``out``, accepted and rejected rows apart.

    One parse and one write; ``accepted`` is what ``read_events_csv`` with
    ``unreadable="skip"`` gives, ``rejected`` what ``rejected_events_csv`` does, both
    read from the stored files.
    """
    rows = text_rows(spark, path, multi_line, required)
    values, unread = _parsed(rows, blank_strings, id_type)
    # The check is one column of the pass, so that the values are not looked at again by every use of it.
    checked = rows.withColumn("_reason", _reason(unread))
    texts = [F.col(f"`{n}`") for n in values]
    stored = checked.select(
        F.col("_reason").isNull().alias("accepted"),
        F.when(F.col("_reason").isNull(), F.struct(*[v.alias(n) for n, v in values.items()])).alias("event"),
        F.when(F.col("_reason").isNotNull(), F.struct(*texts, F.col("_reason").alias("reason"))).alias("text"),
        ROW,
    )
    both = _stored_split(stored, out, mode)
    return SplitLog(both.where("accepted").select("event.*", ROW), both.where("NOT accepted").select("text.*", ROW))


def store_checked(events: DataFrame, out: str, mode: str = "error") -> SplitLog:
    """Store a log as Parquet under ``out``, rows that the jobs can use apart from the incomplete ones, in one pass."""
    both = _stored_split(events.withColumn("accepted", complete()), out, mode)
    return SplitLog(both.where("accepted").drop("accepted"), both.where("NOT accepted").drop("accepted"))


def _stored_split(rows: DataFrame, out: str, mode: str) -> DataFrame:
    """``rows`` written by their column ``accepted``, which a reader uses to choose files, and read again."""
    rows.write.mode(mode).partitionBy("accepted").parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def read_events_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet log; ``row_pos`` is taken from the file or from the row's place in it.

    Ids keep their type, other columns get the types of ``EVENTS``; a value that does not fit raises.
    NaN counts as missing.
    """
    raw = check_columns(spark.read.parquet(path))
    columns = []
    for field in raw.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        kind = _KNOWN.get(field.name)
        if kind is not None and field.name not in IDS and field.dataType != kind:
            read = value.try_cast(kind)
            lost = value.isNotNull() & (read.isNull() | (read.try_cast("double") != value.try_cast("double")))
            message = F.concat(F.lit(f"{path}: {field.name} is not {kind.simpleString()}: "), value.cast("string"))
            whole = not isinstance(kind, (T.DoubleType, T.StringType))
            value = F.when(lost if whole else value.isNotNull() & read.isNull(), F.raise_error(message)).otherwise(read)
        columns.append(value.alias(field.name))
    if ROW not in raw.columns:
        columns.append(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(ROW))
    return raw.select(*columns)


def write_events(windowed: DataFrame, path: str, fmt: str = "csv", mode: str = "error", by_range: bool | None = None) -> None:
    """Write the filtered log, in order within every game, as CSV with a header or as Parquet.

    ``by_range`` sorts over all files by game, time and row, at the price of one more shuffle:
    files are then balanced whatever the size of a game, and Parquet statistics allow
    skipping by game. CSV needs it, as it has no ``row_pos`` and the rows of a large game
    may lie in several partitions; Parquet keeps ``row_pos``, so there rows are by default
    sorted where they are.
    """
    _write(_in_file_order(windowed, fmt, by_range), path, fmt, mode)


def _in_file_order(windowed: DataFrame, fmt: str, by_range: bool | None) -> DataFrame:
    if fmt not in ("csv", "parquet"):
        raise ValueError("fmt is 'csv' or 'parquet'")
    by_range = fmt == "csv" if by_range is None else by_range
    order = ["gameid", F.col("compiledgametime").asc_nulls_last(), ROW]
    return windowed.orderBy(*order) if by_range else windowed.sortWithinPartitions(*order)


def _write(in_order: DataFrame, path: str, fmt: str, mode: str) -> None:
    if fmt == "csv":
        in_order.drop(ROW).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        in_order.write.mode(mode).parquet(path)


class SequenceCounts(NamedTuple):
    n_events: int
    n_sequences: int


def write_counted(
    windowed: DataFrame, path: str, fmt: str = "csv", mode: str = "error", by_range: bool | None = None
) -> SequenceCounts:
    """``write_events`` that also counts the events and sequences it writes, in the same pass.

    ``windowed`` is the filtered log with sequence ids, as ``plans.jobs.post_anchor_events`` gives it, or in
    blocks. The counts are observed in the last stage of the write, of which every partition
    counts once however often it was tried. A sequence counts at its first row; where a game was cut into
    blocks, its last row before and its first row after each cut tell whether it went on.
    """
    block = F.col(BLOCK) if BLOCK in windowed.columns else F.lit(0)
    keys = ["gameid", BLOCK] if BLOCK in windowed.columns else ["gameid"]
    ordered = Window.partitionBy(*keys).orderBy(F.col("compiledgametime").asc_nulls_last(), ROW)
    own, before, after = F.col("faceoff_sequence_id"), F.lag("faceoff_sequence_id").over(ordered), F.lead("faceoff_sequence_id").over(ordered)
    at_cut = F.when(block > 0, F.struct(F.col("gameid").alias("game"), block.alias("block"), own.alias("sequence")))
    marked = windowed.withColumns(
        {
            "_starts": before.isNull() | (before != own),
            "_head": F.when(before.isNull(), at_cut),
            "_tail": F.when(after.isNull(), at_cut),
        }
    )
    seen = Observation()
    counted = _in_file_order(marked, fmt, by_range).observe(
        seen,
        F.count(F.lit(1)).alias("events"),
        F.count_if("_starts").alias("starts"),
        F.collect_set("_head").alias("heads"),
        F.collect_set("_tail").alias("tails"),
    )
    _write(counted.select(*[c for c in windowed.columns if c != BLOCK]), path, fmt, mode)
    found = seen.get
    # At most one row of each per block.
    last = sorted((t.game, t.block, t.sequence) for t in found["tails"])
    places = [t[:2] for t in last]
    gone_on = 0
    for head in found["heads"]:
        i = bisect_left(places, (head.game, head.block)) - 1
        gone_on += i >= 0 and last[i][0] == head.game and last[i][2] == head.sequence
    return SequenceCounts(found["events"], found["starts"] - gone_on)


def write_ratings(export: DataFrame, path: str, mode: str = "error") -> None:
    """Write the sorted ratings table as CSV; missing values are written as ``NA``."""
    writer = export.write.mode(mode).option("header", True).option("nullValue", "NA")
    writer.option("escape", '"').csv(path)
