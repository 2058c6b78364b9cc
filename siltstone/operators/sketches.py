"""Mergeable states of distinct counts, quantiles and frequent values (extensions; the reference has none).

States are columns that are written, kept by part (a day, a file) and merged later by any coarser grouping, without the
rows. All is done by Spark's own sketch functions; a state's size is bounded whatever it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as a power of two: a standard error of 1.6 %.
DISTINCT_BITS = 12
#: Size of a quantile state: ranks are within about 1.4 %.
QUANTILE_SIZE = 200
#: Values that a frequency state tracks; counts are exact while there are no more different ones.
TRACKED = 10_000


def states(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """df -> (*by, rows, distinct_state, value_state, top_state) of the columns `distinct` (any type that the distinct
    count takes; its frequent values are tracked too) and `value` (a number). Nulls count as rows only."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(F.col(distinct), F.lit(DISTINCT_BITS)).alias("distinct_state"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("value_state"),
        F.expr(f"approx_top_k_accumulate(`{distinct}`, {TRACKED})").alias("top_state"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """States of finer groups -> states of coarser ones, in the same columns; they can be merged again."""
    return parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.kll_merge_agg_double("value_state").alias("value_state"), F.expr(f"approx_top_k_combine(top_state, {TRACKED})").alias("top_state"),
    )


def estimates(found: DataFrame, by: list[str], shares: list[float], top: int) -> DataFrame:
    """(*by, rows, distinct, quantiles, top): the number of different values, the values at the shares, and the `top` most
    frequent ones with their counts."""
    wanted = F.array(*map(F.lit, shares))
    return found.select(
        *by, "rows", F.hll_sketch_estimate("distinct_state").alias("distinct"),
        F.kll_sketch_get_quantile_double("value_state", wanted).alias("quantiles"),
        F.expr(f"approx_top_k_estimate(top_state, {top})").alias("top"),
    )
