"""Mean of the newer half minus mean of the older half of each group, in time order.

A plain ``row_number`` would sort a whole group in one task. Here each group is first counted
per minute, which bounds the window by the length of the period and not by the data. Running
totals find the one minute that holds the midpoint; everything before it is already summed. Only
a minute that the midpoint cuts is opened: first by (timestamp, tie prefix), then row by row inside
the one small cell that is cut. Nothing is sampled; the split is exact.

The rows are read twice: once for the counts and once for the opened minutes, which both steps of
the cut share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.operators.frames import shared_exchange, taken

Expand = Callable[[DataFrame], DataFrame]

# What is known of a group once its midpoint is located: totals and the older part so far.
KNOWN = ["n_all", "sum_all", "count_all", "older_sum", "older_count", "need"]
#: Letters of the tie that a cut timestamp is divided by. Ties are hashes; rows without one get the hash of the row.
CELL = 4


def minute_measures(value: str) -> list[Column]:
    """What is counted per minute."""
    return [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.count(value).alias("n_value")]


def tie_of(df: DataFrame, tie: str) -> Column:
    """The tie column, or the hash of the whole row where it is absent or empty."""
    whole = F.sha2(F.to_json(F.struct("*")), 256)
    return F.coalesce(F.nullif(F.col(tie), F.lit("")), whole) if tie in df.columns else whole


def _located(bins: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Marks the one bin per group that holds the last older row (place 1, or 2 where it is cut).

    bins: (keys, order, n, total, n_value, KNOWN). ``need`` becomes how many rows of the marked
    bin are older; a bin taken whole is already added to the older part.
    """
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {name: F.coalesce(F.sum(name).over(ahead), F.lit(0)) for name in ("n", "total", "n_value")}
    placed = bins.withColumns({f"{name}_before": c for name, c in before.items()})
    rest = F.col("need") - F.col("n_before")
    holds = (rest > 0) & (rest <= F.col("n"))
    placed = placed.withColumn("place", F.when(holds & (rest < F.col("n")), 2).when(holds, 1).otherwise(0))
    whole = (F.col("place") == 1).cast("int")
    return placed.withColumns({
        "older_sum": F.col("older_sum") + F.col("total_before") + F.coalesce("total", F.lit(0.0)) * whole,
        "older_count": F.col("older_count") + F.col("n_value_before") + F.col("n_value") * whole,
        "need": rest})


def locate_midpoints(minutes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _minute, n, total, n_value, ...) -> with KNOWN, n_before and place: 1 in the minute that holds
    the last older row, 2 in it where the midpoint cuts it, else 0."""
    whole = Window.partitionBy(*keys)
    minutes = minutes.withColumns({
        "n_all": F.sum("n").over(whole), "sum_all": F.sum("total").over(whole),
        "count_all": F.sum("n_value").over(whole), "older_sum": F.lit(0.0), "older_count": F.lit(0).cast("bigint")})
    minutes = minutes.withColumn("need", F.greatest(F.lit(1), F.floor(F.col("n_all") / 2)))
    return _located(minutes, keys, ["_minute"])


def finish_split(opened: DataFrame, keys: Sequence[str]) -> DataFrame:
    """-> (keys, momentum). ``opened``: (keys, _minute, place, _ts, _tie, _value, KNOWN), the rows of at least the
    minutes with a place. Only rows of a minute that is cut are shuffled again; all readers share one exchange."""
    keys = list(keys)
    final = ["n_all", "sum_all", "count_all", "older_sum", "older_count"]

    def known(names: Sequence[str]) -> list[Column]:
        return [F.max(name).alias(name) for name in names]

    cut = taken(opened, F.col("place") == 2).withColumn("_cell", F.substring("_tie", 1, CELL))
    cells = cut.groupBy(*keys, "_ts", "_cell").agg(*minute_measures("_value"), *known(KNOWN))
    cell = _located(cells, keys, ["_ts", "_cell"])
    cut_cells = cell.where("place = 2").select(*keys, "_ts", "_cell", *KNOWN)
    in_cell = Window.partitionBy(*keys, "_ts", "_cell").orderBy("_tie", "_value")
    singles = (cut.drop(*KNOWN, "place").join(cut_cells, [*keys, "_ts", "_cell"])
               .withColumn("_rank", F.row_number().over(in_cell)).where(F.col("_rank") <= F.col("need"))
               .groupBy(*keys).agg(
                   *[F.max(name).alias(name) for name in ("n_all", "sum_all", "count_all")],
                   (F.max("older_sum") + F.coalesce(F.sum("_value"), F.lit(0.0))).alias("older_sum"),
                   (F.max("older_count") + F.count("_value")).alias("older_count")))
    uncut = taken(opened, F.col("place") == 1).groupBy(*keys).agg(*known(final))
    done = (uncut.unionByName(cell.where("place = 1").select(*keys, *final))
            .unionByName(singles.select(*keys, *final)))
    older = F.try_divide("older_sum", F.nullif("older_count", F.lit(0)))
    newer = F.try_divide(F.col("sum_all") - F.col("older_sum"),
                         F.nullif(F.col("count_all") - F.col("older_count"), F.lit(0)))
    move = F.greatest(F.least(F.coalesce(newer, older) - older, F.lit(1.0)), F.lit(-1.0))
    return done.select(*keys, F.when(F.col("n_all") < 2, F.lit(0.0)).otherwise(
        F.coalesce(move, F.lit(0.0))).alias("momentum"))


def half_split_momentum(rows: DataFrame, group: Sequence[str], ts: str, tie: str, value: str,
                        keys: Sequence[str] | None = None, expand: Expand | None = None) -> DataFrame:
    """-> (keys, momentum), clamped to [-1, 1]; groups of one row give 0.0.

    ``group`` are the columns of ``rows`` to count by. ``expand`` may fan the counted minutes out
    to ``keys`` (sliding frames): counts are repeated then, never the rows themselves, except for
    the rows of the minutes that a midpoint cuts.
    """
    keys = list(keys or group)
    narrow = rows.select(
        *group, F.date_trunc("minute", ts).alias("_minute"), F.col(ts).alias("_ts"),
        tie_of(rows, tie).alias("_tie"), F.col(value).alias("_value"))
    minutes = narrow.groupBy(*group, "_minute").agg(*minute_measures("_value"))
    located = locate_midpoints(expand(minutes) if expand else minutes, keys)
    cut = located.where("place > 0").select(*dict.fromkeys([*group, *keys]), "_minute", "place", *KNOWN)
    return finish_split(shared_exchange(narrow.join(cut, [*group, "_minute"]), [*keys, "_ts", "_tie"]), keys)
