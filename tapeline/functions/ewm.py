"""Exponential means as window sums.

``EMA_k = (1-a) EMA_{k-1} + v_k`` unrolls to ``sum(v_i r^(k-i))`` with ``r = 1-a``,
which is a running sum of ``v_i r^-i`` scaled back by ``r^k``. The powers leave the
double range on long series, so rows are cut into blocks: the running sum restarts
in each block, and what earlier blocks contribute is folded from their end values.

The functions return named columns for one ``withColumns`` step each, so that a
caller can put its other windows into the same steps:

    powers -> sums -> (blocked only: earlier_ends) -> results

All windows have the ticker as partition and (block, date) as order. They share one
exchange, and one sort serves the per-block and the per-ticker windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# A block spans at most r^±600 around its middle, inside the double range of about e^±709.
_HALF_SPAN = 600.0


@dataclass(frozen=True)
class Decay:
    """Sum of ``value`` (NULL = no term) decaying by ``rate`` per counted row."""

    name: str
    value: Column
    rate: float


def block_rows(rates: list[float]) -> int:
    """Most rows one block may hold, set by the fastest decay."""
    return int(2 * _HALF_SPAN / -math.log(min(rates)))


def powers(decays: list[Decay], index: Column, span: int) -> dict[str, Column]:
    """``rate ^ index`` per decay and its terms divided by it, ``index`` counted from mid-block."""
    out = {}
    for d in decays:
        scale = F.pow(F.lit(d.rate), index - span / 2)
        out[f"_p{d.name}"] = scale
        out[f"_v{d.name}"] = d.value / scale
    return out


def sums(decays: list[Decay], cells: WindowSpec) -> dict[str, Column]:
    """Decayed sums within a block."""
    return {d.name: F.sum(f"_v{d.name}").over(cells) * F.col(f"_p{d.name}") for d in decays}


def earlier_ends(
    decays: list[Decay], is_end: Column, earlier: WindowSpec, name: str = "_ends"
) -> dict[str, Column]:
    """The end values of all finished blocks before each row.

    The array is empty for a ticker that fits in one block and has one entry per
    several thousand rows otherwise.
    """
    entry = F.struct(*[d.name for d in decays])
    return {name: F.collect_list(F.when(is_end, entry)).over(earlier)}


def results(
    decays: list[Decay], index: Column, span: int, block: str | None, ends: str = "_ends"
) -> dict[str, Column]:
    """Full decayed sums: the block's own plus the fold of the earlier ends."""
    if block is None:
        return {}

    def folded(d: Decay) -> Column:
        step = d.rate ** span
        return F.aggregate(
            ends, F.lit(0.0), lambda acc, e: F.coalesce(e[d.name], F.lit(0.0)) + acc * step
        )

    return {
        d.name: F.when(F.col(block) == 0, F.col(d.name)).otherwise(
            F.coalesce(F.col(d.name), F.lit(0.0)) + F.pow(F.lit(d.rate), index) * folded(d)
        )
        for d in decays
    }


def ema_terms(value: Column, count: Column, seed: Column, length: int, skip: int = 0) -> Column:
    """Terms of an EMA whose first value is ``seed``, the mean of its first ``length`` values.

    ``count`` numbers the rows with a value, of which the first ``skip`` are left
    out. Rows before the seed and rows without a value contribute nothing.
    """
    alpha, start = 2.0 / (length + 1), length + skip
    seeded = F.when(count == start, seed).when(count > start, value * alpha)
    return F.when(value.isNotNull(), seeded)


def ema_rate(length: int) -> float:
    return 1.0 - 2.0 / (length + 1)


def wilder_rate(length: int) -> float:
    return 1.0 - 1.0 / length
