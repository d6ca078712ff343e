"""The rows of CSV files as text, whatever the files' headers and the line breaks in their fields.

Every file has a header of its own. The headers are read first, by one short task per
file; files are then read in groups of equal headers, and the groups united by name.

A quoted field may hold line breaks. Such files are read in parallel too: a line begins
inside a quoted field if the lines before it hold an odd number of quotes, so one pass
counts the quotes of every split, their prefix sums tell how each split begins, and each
task then joins the lines of its own records. Only the pieces of records that lie
across splits, two per split at most, are brought together. In such files a field with a quote must
itself be quoted, as pandas and R write it.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorwake.sources.settle import settle

ROW = "row_pos"
SURPLUS = "_surplus"
_NOTHING = "\x00"  # read as a missing field, so that blank fields arrive as they are
_OPTIONS = {"quote": '"', "escape": '"', "nullValue": _NOTHING, "emptyValue": ""}
#: Splits that begin inside a quoted field, up to which their table is broadcast.
_OPEN_SPLITS = 100_000
_WHOLE_FILE = 1 << 36


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The lines of text files with their file and the place of their split in it."""
    text = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _first_lines(spark: SparkSession, paths: str | Sequence[str], all_of: bool) -> dict[str, str]:
    """The first line of each file; unless ``all_of``, of the first file of each task."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                if file not in seen and batch.column(1)[i].as_py() == 0:
                    seen.add(file)
                    yield batch.slice(i, 1)
                if not all_of:
                    return  # the rest of the split is not read

    # Files are neither cut nor packed together, so that every task sees the beginning of one.
    whole = {"spark.sql.files.maxPartitionBytes": str(_WHOLE_FILE), "spark.sql.files.openCostInBytes": str(_WHOLE_FILE)}
    with _settings(spark, {} if all_of else whole | {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        lines = _lines(spark, paths)
        return {r.file: r.value for r in lines.mapInArrow(take, lines.schema).collect()}


def _names(line: str, file: str) -> tuple[str, ...]:
    """The columns that a header names: blank names by place, repeated ones with a number, as pandas does."""
    line = line.removeprefix("﻿").removesuffix("\r")
    if line.count('"') % 2:
        raise ValueError(f"{file}: a line break in the header")
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([line]), [])):
        plain = name = name or f"_c{i}"
        known, k = {n.lower() for n in names}, 0
        while name.lower() in known:
            k += 1
            name = f"{plain}.{k}"
        names.append(name)
    return tuple(names)


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by the columns that their headers name, in the order of their paths.

    One line of each file is read. Like Spark's own list of files, the result has an
    entry per file; empty files are in none.
    """
    first = _first_lines(spark, path, all_of=False)
    listed = {_plain(f): f for f in _lines(spark, path).inputFiles()}
    missed = [_escaped(f) for key, f in listed.items() if key not in {_plain(x) for x in first}]
    if missed:  # empty, or packed into the task of another file after all
        first |= _first_lines(spark, missed, all_of=True)
    groups = defaultdict(list)
    for file in sorted(first):
        groups[_names(first[file], file)].append(file)
    return dict(groups)


def _plain(file: str) -> str:
    """A file's path, however its address is written."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(file))


def _escaped(file: str) -> str:
    """A file's address as a path that names this file only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def text_rows(spark: SparkSession, path: str, multi_line: bool = False, required: Sequence[str] = ()) -> DataFrame:
    """All fields as text by name, ``_surplus`` with the first field beyond a row's header, and ``row_pos``.

    Blank fields, and those that a row lacks, are null; a quoted blank is an empty text. Columns stand in the order of
    the first file, then those that only later files have, which are null in the others. A
    file without a ``required`` column raises an error. ``row_pos`` sorts files by path
    and rows by their place.
    """
    groups = files_by_header(spark, path)
    if not groups:
        raise ValueError(f"{path}: no file with a header")
    for names, files in groups.items():
        absent = [c for c in required if c not in names]
        if absent:
            raise ValueError(f"{files[0]}: the log has no column {', '.join(absent)}")
    read = _joined_rows if multi_line else _plain_rows
    parts = [read(spark, path if len(groups) == 1 else [_escaped(f) for f in files], names) for names, files in groups.items()]
    if len(parts) == 1:
        return parts[0]
    columns = list(dict.fromkeys(n for names in groups for n in names))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return united.select(*[F.col(f"`{n}`") for n in columns], SURPLUS, ROW)


def _schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])


def _plain_rows(spark: SparkSession, paths: str | list[str], names: Sequence[str]) -> DataFrame:
    """Rows of one line each."""
    reader = spark.read.options(**_OPTIONS).option("header", True).option("enforceSchema", True)
    rows = reader.schema(_schema(names)).csv(paths)
    # The splits of a file are read in order, so the file, the place of the split in it
    # and a running number sort the rows.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn(ROW, place)


def _joined_rows(spark: SparkSession, paths: str | list[str], names: Sequence[str]) -> DataFrame:
    """Rows of any number of lines."""
    records = records_of_lines(_lines(spark, paths))
    fields = F.from_csv(F.regexp_replace("text", r"\r$", ""), _ddl(names), _OPTIONS)
    return records.where("text NOT IN ('', '\\r')").select(fields.alias("_fields"), F.struct("file", "block", "row").alias(ROW)).select("_fields.*", ROW)


def _ddl(names: Sequence[str]) -> str:
    return ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in [*names, SURPLUS])


def split_openings(lines: DataFrame) -> DataFrame:
    """The splits that begin inside a quoted field: ``file, block``. Raises for a file whose last field does not end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = settle(lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")))
    open_end = odd.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").first()
    if open_end:
        raise ValueError(f"{open_end.file}: a quoted field does not end")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "block", (F.sum("odd").over(before) % 2).alias("open")).where("open = 1").drop("open")


def records_of_lines(lines: DataFrame) -> DataFrame:
    """``file, block, row, text``: the records of files with a header, without it, each at the place of its first line."""
    openings = settle(split_openings(lines))
    numbered = lines.withColumn("row", F.monotonically_increasing_id())
    few = openings.count() <= _OPEN_SPLITS
    marked = openings.withColumn("open", F.lit(True))
    joined = numbered.join(F.broadcast(marked) if few else marked, ["file", "block"], "left")
    if not few:  # the join has dealt the lines by split; put them in order again
        joined = joined.sortWithinPartitions("file", "block", "row")
    schema = "file string, block long, row long, text string, begins boolean, ends boolean"
    pieces = joined.select("file", "block", "row", "value", F.coalesce("open", F.lit(False)).alias("open")).mapInArrow(_assembler(), schema)
    whole = pieces.where("begins AND ends").drop("begins", "ends")
    # What lies across splits: two pieces of each split at most.
    torn = pieces.where("NOT (begins AND ends)")
    so_far = Window.partitionBy("file").orderBy("block", "row")
    torn = torn.withColumn("record", F.sum(F.col("begins").cast("bigint")).over(so_far))
    parts = F.sort_array(F.collect_list(F.struct("block", "row", "text")))
    mended = torn.groupBy("file", "record").agg(parts.alias("parts"))
    mended = mended.select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["row"].alias("row"), F.array_join("parts.text", "\n").alias("text")
    )
    return whole.unionByName(mended)


def _assembler() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the lines of each record within a split; records that begin or end elsewhere come in pieces.

    A function within a function travels to the workers whole, so they need not have this package.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, held, begins, at = None, 0, [], False, 0

        def piece(ends: bool) -> pa.RecordBatch:
            columns = [[split[0]], [split[1]], [at], ["\n".join(held)], [begins], [ends]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        names = ["file", "block", "row", "text", "begins", "ends"]
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, row, value, opened = batch.columns
            codes = np.asarray(pc.dictionary_encode(file).indices)
            changed = np.flatnonzero((np.diff(codes) != 0) | (np.diff(np.asarray(block)) != 0)) + 1
            odd = np.asarray(pc.count_substring(value, '"')) & 1
            for a, b in zip([0, *changed], [*changed, batch.num_rows], strict=True):
                here = file[a].as_py(), block[a].as_py()
                first = a
                if here != split:
                    if held:
                        yield piece(False)
                    split, inside, held, begins, at = here, int(opened[a].as_py()), [], False, row[a].as_py()
                    first += here[1] == 0  # the header
                before = (inside + np.cumsum(odd[a:b]) - odd[a:b]) & 1
                before[: first - a] = 0
                lone = np.flatnonzero((before == 0) & (odd[a:b] == 0)) + a
                lone = lone[lone >= first]
                if len(lone):
                    take = pa.array(lone)
                    yes = pa.array(np.ones(len(lone), bool))
                    yield pa.RecordBatch.from_arrays([file.take(take), block.take(take), row.take(take), value.take(take), yes, yes], names)
                for i in np.flatnonzero((before == 1) | (odd[a:b] == 1)) + a:
                    if i < first:
                        continue
                    if not before[i - a]:
                        begins, at = True, row[int(i)].as_py()
                    held.append(value[int(i)].as_py())
                    if before[i - a] and odd[i]:
                        yield piece(True)
                        held, begins = [], False
                inside = (int(before[-1]) + int(odd[b - 1])) & 1 if b > first else inside
        if held:
            yield piece(False)

    return assemble
