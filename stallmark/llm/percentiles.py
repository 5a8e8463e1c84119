"""Percentiles of very large numeric columns: radix selection over mergeable summaries.

The method (order-preserving integers, digit histograms, only the digit of each target rank followed) is in
``stallmark.operators.percentiles``, which other operators of the library use too; this module fixes the quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stallmark.operators import percentiles as core
from stallmark.operators.percentiles import key_value, merge, order_key, summarise, with_levels
from stallmark.session import cut

__all__ = ["QUANTILES", "key_value", "merge", "order_key", "radix_select", "summarise", "with_levels"]

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def radix_select(summary: DataFrame, groups: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Order statistics of rank ceil(q * n) per group of a summary: groups, ``q``, ``n``, ``value``.

    Repeated values count as often as they occur; a group of one value gives it for every q; an empty summary gives no
    rows. The summary is written once, each digit reads it again.
    """
    return core.radix_select(cut(summary), groups, quantiles)
