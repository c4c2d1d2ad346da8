"""Exact median per group without bringing a group together.

``median`` keeps every distinct value of a group in one task. Here a mergeable quantile summary,
whose rank error is bounded, first gives a narrow bracket around the middle; then everything
below the bracket is only counted, and only distinct values inside it are ordered. The brackets of few groups
go to the values, which are then reduced before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.session import staged

ACCURACY = 10_000
SALTS = 32
#: Up to so many groups their brackets are sent to the values; of more, values and brackets are both shuffled.
FEW_GROUPS = 10_000


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """-> (keys, name). NULL values are ignored."""
    keys = list(keys)
    margin = 2.0 / ACCURACY
    bracket = (df.groupBy(*keys).agg(
        F.count(value).alias("_total"),
        F.percentile_approx(value, [0.5 - margin, 0.5 + margin], ACCURACY).alias("_q"))
        .select(*keys, F.col("_total"), F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high")))
    bracket = staged(bracket, "brackets")
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if bracket.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        placed = values.withColumn("_n", F.lit(1)).join(F.broadcast(bracket), keys)
    else:
        # A group can be most of the data, so the one bracket row per group meets it in SALTS pieces.
        counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        salted = bracket.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = (counts.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
                  .join(salted, [*keys, "_salt"]))
    placed = placed.where(F.col("_v") <= F.col("_high"))
    below = F.col("_v") < F.col("_low")
    # Values under the bracket collapse to one counted row, the rest stay as they are.
    narrowed = (placed.groupBy(*keys, F.when(~below, F.col("_v")).alias("_v"))
                .agg(F.sum("_n").alias("_n"), F.first("_total").alias("_total")))
    running = (Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, 0))
    ranked = narrowed.withColumn("_upto", F.sum("_n").over(running))
    lower_rank = F.floor((F.col("_total") + 1) / 2)
    upper_rank = F.floor((F.col("_total") + 2) / 2)
    picked = ranked.where(F.col("_v").isNotNull()).groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") >= lower_rank, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") >= upper_rank, F.col("_v"))).alias("_b"))
    return picked.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))
