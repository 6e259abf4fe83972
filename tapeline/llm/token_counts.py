"""Token counts by an exact length histogram.

Documents are encoded where they lie and counted by encoded length. Suffix sums over the lengths
then answer, for every context limit, how many documents and tokens are longer and how many
tokens are left when each document is cut at the limit.

The sums are taken in two levels, within blocks of ``BLOCK`` lengths and over the blocks, so
that no task gets all lengths.

Defined results: NULL and empty texts have length 0; repeated rows and ids count each; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.bpe import automaton, default_path
from tapeline.llm.common import map_texts
from tapeline.session import materialize

BLOCK = 4096


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the number of tokens of its whole text."""
    path = path or default_path()

    def run(texts: list[str | None]) -> dict:
        machine = automaton(path)
        return {"n_tokens": [len(machine.encode(text)) // 4 for text in texts]}

    return map_texts(docs, run, "n_tokens long")


def length_table(counted: DataFrame) -> DataFrame:
    """One row per length ``n_tokens``, taken as a limit.

    ``n_docs`` have that length, ``docs_longer`` and ``tokens_longer`` lie above it, and
    ``truncated_tokens`` is the total once every document is cut at it; ``total_docs`` and ``total_tokens`` hold for all.
    """
    hist = materialize(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda own, rest: F.coalesce(F.sum(own).over(inside), F.lit(0)) + F.col(rest)
    table = hist.join(sums, "block").withColumns({"docs_longer": longer("n_docs", "d"), "tokens_longer": longer("tokens", "t")})
    cut = F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return table.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", cut.alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of all documents do not pass; one row, NULL without documents."""
    reached = F.col("total_docs") - F.col("docs_longer") >= share * F.col("total_docs")
    return table.where(reached).agg(F.min("n_tokens").alias("n_tokens"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """The columns of ``length_table`` for any context limits, one row each; none without documents.

    What is longer than a limit is what is longer than the largest length up to it, or everything.
    """
    below = {n: F.max_by(F.struct("docs_longer", "tokens_longer"), F.when(F.col("n_tokens") <= n, F.col("n_tokens"))) for n in limits}
    exact = {n: F.coalesce(F.sum(F.when(F.col("n_tokens") == n, F.col("n_docs"))), F.lit(0)) for n in limits}
    summed = table.agg(
        F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"),
        F.array(*[F.struct(F.lit(n).cast("long").alias("n_tokens"), exact[n].alias("n_docs"), below[n].alias("b")) for n in limits]).alias("rows"),
    ).where(F.col("total_docs").isNotNull())
    rows = summed.select("total_docs", "total_tokens", F.explode("rows").alias("r")).select("total_docs", "total_tokens", "r.*")
    rows = rows.withColumns({
        "docs_longer": F.coalesce("b.docs_longer", "total_docs"), "tokens_longer": F.coalesce("b.tokens_longer", "total_tokens"),
    })
    cut = F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return rows.withColumn("truncated_tokens", cut).select(*table.columns)


# Context limits that the query reports beside the lengths it meets, and quantiles of the lengths.
LIMITS = [1 << k for k in range(7, 21)]
SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every encoded length of ``documents`` and every power of two in ``LIMITS`` as a limit, beside quantiles of the lengths."""
    table = materialize(length_table(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    rows = table.unionByName(at_limits(table, LIMITS).where("n_docs = 0"))
    return rows.withColumns({name: quantile(table, share).scalar() for name, share in SHARES.items()})
