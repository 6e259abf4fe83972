"""Versioned fact tables, copied on write by cell.

A cell is a month and a bucket of tickers; its rows are one parquet file, sorted by ticker and date.

* ``data/<write>/month=M/cell=B/`` holds the cells that one write made; files are never changed.
* ``snapshots/<name>/`` lists the cells of one state of the table and the write that made each.
* ``current`` names the valid snapshot. It is replaced by one rename, so that a reader sees the state before a
  write or after it, and a write that fails at any point leaves the old one.

The number of a cell's bucket is Spark's own for ``ticker_code``, and files carry it in their names: a snapshot
is read as a bucketed table whose partitions lie where the snapshot says. Windows and joins by ticker
then need no exchange, months prune partitions, and ticker lists prune buckets.

A snapshot has one row for each cell: months times buckets. A new table gets buckets that a full month fills
with ``CELL_ROWS`` rows or more, so that files, partitions and their entries follow the rows, not the tickers alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import new_folder, small_table

BUCKET_TICKERS, LEAST_BUCKETS = 256, 4
CELL_ROWS, MONTH_DAYS = 16_384, 30
LAYOUT = [T.StructField("month", T.StringType()), T.StructField("cell", T.IntegerType())]
Cell = tuple[str, int]


def bucket_count(tickers: int) -> int:
    """Buckets for a table of so many tickers: a power of two, with room for growth."""
    return max(LEAST_BUCKETS, 1 << max(0, (tickers - 1) // BUCKET_TICKERS).bit_length())


def buckets_for(tickers: int, rows: int, days: int) -> int:
    """Buckets for a table that starts with so many rows of so many tickers on so many days.

    ``bucket_count``, or fewer where the tickers seldom have rows: a cell that a full month fills with
    less than ``CELL_ROWS`` rows costs more to open, list and register than to read.
    """
    in_a_month = rows * MONTH_DAYS // max(1, days)
    by_rows = 1 << max(0, (in_a_month - 1) // CELL_ROWS).bit_length()
    return max(LEAST_BUCKETS, min(bucket_count(tickers), by_rows))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def cell_of(ticker_code: Column, buckets: int) -> Column:
    """The bucket that Spark's bucketed writer picks."""
    return F.pmod(F.hash(ticker_code), F.lit(buckets))


def placed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` with the cell of each row."""
    return df.withColumns({"month": month_of(F.col("date")), "cell": cell_of(F.col("ticker_code"), buckets)})


@dataclass(frozen=True)
class Snapshot:
    """One state of a table: its name, the bucket count, and the write that made each cell."""

    name: str
    buckets: int
    cells: dict[Cell, str]


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _hadoop(spark, path)
    return system.exists(found)


def current(spark: SparkSession, path: str) -> Snapshot | None:
    """The valid snapshot; None when nothing is stored yet."""
    if not exists(spark, f"{path}/current"):
        return None
    named = json.loads(spark.read.text(f"{path}/current", wholetext=True).first()[0])
    rows = spark.read.schema("month string, cell int, made_by string").parquet(f"{path}/snapshots/{named['name']}").collect()
    return Snapshot(named["name"], named["buckets"], {(r["month"], r["cell"]): r["made_by"] for r in rows})


def _switch(spark: SparkSession, path: str, before: Snapshot | None, after: Snapshot) -> None:
    """List the new state, then make it the valid one by a rename."""
    rows = [(month, cell, made_by) for (month, cell), made_by in sorted(after.cells.items())]
    small_table(spark, rows, "month string, cell int, made_by string").coalesce(1).write.parquet(f"{path}/snapshots/{after.name}")
    staged, system = _hadoop(spark, f"{path}/.current-{after.name}")
    out = system.create(staged)
    out.write(json.dumps({"name": after.name, "buckets": after.buckets}).encode())
    out.close()
    now = current(spark, path)
    if (now and now.name) != (before and before.name):
        system.delete(staged, False)
        raise RuntimeError(f"{path} was changed by another writer")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    # A typed array: renaming takes a variable number of options.
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{path}/current"), options)


def _stored_fields(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + LAYOUT)


def read(spark: SparkSession, path: str, schema: T.StructType, snapshot: Snapshot | None) -> DataFrame:
    """The rows of a snapshot with ``month`` and ``cell``, known to Spark as bucketed by ticker."""
    if snapshot is None or not snapshot.cells:
        return spark.createDataFrame([], _stored_fields(schema))
    table = f"tapeline_{hashlib.md5(f'{path}/{snapshot.name}'.encode()).hexdigest()}"
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _stored_fields(schema))
        spark.sql(
            f"CREATE TABLE {table} ({fields}) USING parquet PARTITIONED BY (month, cell) "
            f"CLUSTERED BY (ticker_code) SORTED BY (ticker_code, date) INTO {snapshot.buckets} BUCKETS "
            f"LOCATION '{path}/snapshots/{snapshot.name}/cells'"
        )
        where = [
            f"PARTITION (month='{month}', cell={cell}) LOCATION '{path}/data/{made_by}/month={month}/cell={cell}'"
            for (month, cell), made_by in sorted(snapshot.cells.items())
        ]
        for at in range(0, len(where), 500):
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(where[at : at + 500]))
    return spark.table(table)


def in_cells(df: DataFrame, cells: set[Cell]) -> DataFrame:
    """The rows of exactly these cells; months with the same buckets share a condition, which prunes partitions."""
    months: dict[str, list[int]] = {}
    for month, cell in sorted(cells):
        months.setdefault(month, []).append(cell)
    alike: dict[tuple[int, ...], list[str]] = {}
    for month, buckets in months.items():
        alike.setdefault(tuple(buckets), []).append(month)
    wanted = F.lit(False)
    for buckets, listed in alike.items():
        wanted = wanted | (F.col("month").isin(listed) & F.col("cell").isin(list(buckets)))
    return df.where(wanted)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Let a join by ticker and date use an existing layout by ticker alone."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def by_ticker(df: DataFrame, buckets: int, clustered: bool = False) -> DataFrame:
    """``df`` written once to the shared folder, bucketed by ticker; ``clustered`` if it already lies that way."""
    spark, name = df.sparkSession, f"tapeline_{uuid.uuid4().hex}"
    rows = df if clustered else df.repartition(buckets, "ticker_code")
    rows.write.bucketBy(buckets, "ticker_code").sortBy("ticker_code", "date").option("path", new_folder(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)


def _write(rows: DataFrame, path: str, buckets: int) -> str:
    """Write the cells of ``rows``, which lie by ticker, and return the write's name."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    table = f"tapeline_{name}"
    try:
        (
            placed(rows, buckets).write.partitionBy("month", "cell").bucketBy(buckets, "ticker_code")
            .sortBy("ticker_code", "date").option("path", f"{path}/data/{name}").format("parquet").saveAsTable(table)
        )
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the table's entry; its files stay
    return name


def written(spark: SparkSession, path: str, made_by: str, schema: T.StructType) -> DataFrame:
    """The rows of one write, with its marks; empty if it made none."""
    if not any(True for _ in _months(spark, f"{path}/data/{made_by}")):
        return spark.createDataFrame([], _stored_fields(schema))
    return spark.read.schema(_stored_fields(schema)).parquet(f"{path}/data/{made_by}")


def _months(spark: SparkSession, folder: str) -> Iterator[str]:
    found, system = _hadoop(spark, folder)
    if system.exists(found):
        for status in system.listStatus(found):
            if status.getPath().getName().startswith("month="):
                yield status.getPath().getName()


def replace_cells(
    spark: SparkSession, path: str, schema: T.StructType, before: Snapshot | None, buckets: int,
    touched: set[Cell], rows: DataFrame, refuse: Column | None = None,
) -> DataFrame:
    """Make ``rows`` the whole content of the cells ``touched``, in one step, and return them as written.

    ``schema`` may have marks beside the table's columns. When ``refuse`` holds for a row, the write is
    left aside and ValueError raised.
    """
    with joined_in_place(spark):
        name = _write(rows, path, buckets)
    made = written(spark, path, name, schema)
    bad = F.lit(False) if refuse is None else refuse
    sizes = made.groupBy("month", "cell").agg(F.count_if(bad).alias("bad")).collect()  # one row a cell
    if any(r["bad"] for r in sizes):
        some = made.where(bad).select("ticker_code", "date").distinct().limit(5).collect()
        raise ValueError(f"repeated keys {[tuple(r) for r in some]}")
    kept = {c: made_by for c, made_by in (before.cells if before else {}).items() if c not in touched}
    cells = kept | {(r["month"], r["cell"]): name for r in sizes}
    _switch(spark, path, before, Snapshot(uuid.uuid4().hex, buckets, cells))
    return made


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete snapshots and writes that the valid snapshot does not use; nobody may be reading or writing older ones."""
    now = current(spark, path)
    used = {"snapshots": {now.name}, "data": set(now.cells.values())} if now else {"snapshots": set(), "data": set()}
    for kind, names in used.items():
        folder, system = _hadoop(spark, f"{path}/{kind}")
        if system.exists(folder):
            for status in system.listStatus(folder):
                if status.getPath().getName() not in names:
                    system.delete(status.getPath(), True)
