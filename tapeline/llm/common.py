"""Helpers shared by the text operators: row access, the word sketch, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 16
NO_ID = -(1 << 63)
BROADCAST_VALUES = 8_000_000
BATCH_ROWS = 1_000


def row_ids(frame: pd.DataFrame) -> np.ndarray:
    """``doc_id`` as numbers; NULL is ``NO_ID``."""
    return np.array([NO_ID if pd.isna(i) else int(i) for i in frame["doc_id"]], np.int64)


def document_id() -> F.Column:
    """``row_ids`` as a column."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def text_hash() -> F.Column:
    """Tells rows of one ``doc_id`` apart, and orders them."""
    return F.xxhash64("text")


def bound_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays.

    A batch is held several times over (JVM buffers, Arrow, Python), and whole texts may be long.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def map_texts(docs: DataFrame, make: Callable[[list[str | None]], dict], schema: str) -> DataFrame:
    """``doc_id``, passed on as it is, beside the columns that ``make`` gets from a list of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = {k: pa.array(v) for k, v in make(batch.column(1).to_pylist()).items()}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **made})

    return bound_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")


def filter_texts(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows, whole and as they are, whose texts ``keep`` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index("text")).to_pylist())))

    return bound_batches(docs).mapInArrow(run, docs.schema)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_texts(frame: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame["text"]]


def sketch_slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each word in a count-min sketch of ``2 * WIDTH`` cells."""
    low, high = hashes & np.uint64(WIDTH - 1), (hashes >> np.uint64(20)) & np.uint64(WIDTH - 1)
    return low.astype(np.int64), high.astype(np.int64) + WIDTH


def total_sketch(counted: DataFrame) -> tuple[np.ndarray, int]:
    """Sums of ``n`` by ``cell``, at most ``2 * WIDTH`` of them, and that of cell -1."""
    sums = counted.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells, inside = np.zeros(2 * WIDTH, np.int64), sums["cell"] >= 0
    cells[sums.loc[inside, "cell"]] = sums.loc[inside, "n"]
    return cells, int(sums.loc[~inside, "n"].sum())


def broadcast_if_few(df: DataFrame, size: F.Column) -> DataFrame:
    """A broadcast hint after adding up the values to be sent; beyond the bound Spark shuffles."""
    total = df.agg(F.sum(size + 8)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_VALUES else df
