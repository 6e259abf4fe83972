"""Session helpers: a local session for tests, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast table is held whole on the driver and on every executor.
BROADCAST_ROW_LIMIT = 250_000
BROADCAST_BYTE_LIMIT = 32 << 20
# Rows that one task of a series job sorts at a time.
TASK_ROWS = 1 << 17


def local_session(cores: int | str = "*", app: str = "tapeline", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets one temporary
    folder per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tapeline-shared-")
    return _local_folders[app]


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tapeline-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder; ``drop_materialized`` clears what is written there."""
    return f"{_application_dir(spark)}/{uuid.uuid4().hex}"


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables that this application wrote with ``materialize``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    Unlike a cache the result survives lost executors, and the file sizes give
    the optimizer true statistics for later joins. ``drop_materialized`` clears all
    such tables of the application.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks of about ``TASK_ROWS`` rows, of ``rows`` in all.

    What a task holds then does not grow with the table. Partitions of a number of bytes, as AQE merges them,
    do not bound it: a series job adds several times the bytes that were shuffled.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows as a local relation: part of the plan, no job to read it."""
    fields = [f.split() for f in schema.split(", ")]
    columns = {name: [str(r[i]) if r[i] is not None else None for r in rows] for i, (name, _) in enumerate(fields)}
    table = pa.table({name: pa.array(values, pa.string()) for name, values in columns.items()})
    return spark.createDataFrame(table).select(*[F.col(n).cast(kind).alias(n) for n, kind in fields])


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows and their bytes as text.

    Beyond a limit the frame comes back without a hint and the join falls to
    Catalyst (sort-merge or shuffled hash, with AQE's skew handling).
    """
    width = F.length(F.to_json(F.struct(*df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= max_rows and size <= BROADCAST_BYTE_LIMIT:
        return F.broadcast(df)
    return df
