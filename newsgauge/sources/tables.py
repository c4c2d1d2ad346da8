"""Stored tables: allow-listed reads, insert-if-absent, upsert, update and append.

The set logic is in plain functions from DataFrame to DataFrame. ``Tables`` adds the files:
each change goes to new folders, so a plan never overwrites what it reads and a failed
job leaves the old version in place.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge import schemas
from newsgauge.operators.keyed import first_rows
from newsgauge.sources.versions import Versions


@dataclass(frozen=True)
class LoadCounts:
    """What a load saw: rows fetched, rows left after removing copies, rows that were new."""

    fetched: int
    after_dedupe: int
    saved: int


# ---------------------------------------------------------------- set logic


def _by_values(df: DataFrame) -> list[Column]:
    """An order by everything in a row, so that a choice among copies never depends on how they arrive. The values
    themselves break ties of the hash: no text of the row is made and shuffled beside it."""
    return [F.xxhash64(*df.columns), *[F.col(c) for c in df.columns]]


def absent_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                order: Sequence[Column] = ()) -> DataFrame:
    """Rows of the batch whose key the target lacks, one per key: the first by ``order``, and of rows that are
    equal there the first by all their values."""
    one_each = first_rows(batch, keys, [*order, *_by_values(batch)])
    return one_each.join(target.select(*keys), list(keys), "left_anti")


def keys_met(stored: DataFrame, batch: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Keys of the batch that are stored. ``few`` keys go to the stored rows; otherwise both sides are shuffled."""
    wanted = batch.select(*keys).distinct()
    return stored.select(*keys).join(F.broadcast(wanted) if few else wanted, list(keys), "left_semi").distinct()


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                     order: Sequence[Column] = ()) -> DataFrame:
    return target.unionByName(absent_rows(target, batch, keys, order), allowMissingColumns=True)


def staged_merge(target: DataFrame, staged: DataFrame, keys: Sequence[str] = ("content_hash",),
                 newest: str = "published_at_utc") -> DataFrame:
    """Newest staged row per key, inserted when the key is not there."""
    return insert_if_absent(target, staged, keys, [F.col(newest).desc_nulls_last()])


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str],
           update_columns: Sequence[str] | None = None, batch_order: str | None = None) -> DataFrame:
    """Merged table: listed columns take the update, the rest keep their first value.

    Of several updates for one key the last by ``batch_order`` wins; without it there must be one, and of
    several that differ the choice is by their values. Columns that only one side
    has are kept, so the table grows additively.
    """
    keys = list(keys)
    if batch_order:
        updates = first_rows(updates, keys, [F.col(batch_order).desc()]).drop(batch_order)
    else:
        updates = first_rows(updates, keys, _by_values(updates))
    changing = [c for c in (update_columns if update_columns is not None else updates.columns) if c not in keys]
    columns = [*target.columns, *[c for c in updates.columns if c not in target.columns]]
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys] or [F.lit(1).alias("_")]).alias("_old"))
    new = updates.select(*keys, F.struct(*[c for c in updates.columns if c not in keys] or [F.lit(1).alias("_")]).alias("_new"))
    joined = old.join(new, keys, "full")
    has_new, has_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def merged(name: str) -> Column:
        in_old, in_new = name in target.columns, name in updates.columns
        if in_old and in_new:
            take_new = has_new if name in changing else (has_new & ~has_old)
            return F.when(take_new, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))
        return F.col(f"_old.{name}") if in_old else F.col(f"_new.{name}")

    return joined.select(*[F.col(c) if c in keys else merged(c).alias(c) for c in columns])


def upsert_positions(target: DataFrame, updates: DataFrame, batch_order: str | None = None) -> DataFrame:
    """Position upsert: no quantity left removes the row, the values are derived."""
    worth = F.col("quantity") * F.col("last_price_cad")
    valued = updates.withColumns({"market_value_cad": worth,
                                  "unrealized_pnl_cad": worth - F.col("quantity") * F.col("avg_cost_cad")})
    merged = upsert(target, valued, ["run_name", "ticker"], batch_order=batch_order)
    return merged.where(F.col("quantity") > 1e-9)


def resolve_alerts(alerts: DataFrame, alert_types: Iterable[str]) -> DataFrame:
    hit = (F.col("status") == "open") & F.col("alert_type").isin(list(alert_types))
    return alerts.withColumn("status", F.when(hit, F.lit("resolved")).otherwise(F.col("status")))


def get_or_create_runs(runs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """(run_name, starting_cash_cad) that are not there yet become active runs with full cash."""
    fresh = wanted.select(
        "run_name", "starting_cash_cad", F.col("starting_cash_cad").alias("cash_cad"),
        F.lit("active").alias("status"), now.alias("created_at_utc"), now.alias("updated_at_utc"))
    return insert_if_absent(runs, fresh, ["run_name"])


def update_cash(runs: DataFrame, cash: DataFrame, now: Column) -> DataFrame:
    """(run_name, cash_cad) for existing runs only; unknown names change nothing."""
    new = cash.select("run_name", F.col("cash_cad").alias("_cash"))
    joined = runs.join(new, "run_name", "left")
    hit = F.col("_cash").isNotNull()
    return joined.withColumns({
        "cash_cad": F.coalesce("_cash", "cash_cad"),
        "updated_at_utc": F.when(hit, now).otherwise(F.col("updated_at_utc"))}).drop("_cash").select(runs.columns)


def run_log_rows(runs: DataFrame, summary: str = "summary_json") -> DataFrame:
    """Lifts the counters out of the JSON summary beside it."""
    fields = {"ticker_count": "$.tickers", "raw_headlines_collected": "$.raw_headlines_collected",
              "scored_headlines": "$.scored_headlines_saved_attempted",
              "insights_generated": "$.insights_generated",
              "trades_executed": "$.simulation.trades_executed"}
    return runs.withColumns({name: F.get_json_object(summary, path).try_cast("int")
                             for name, path in fields.items()})


RUN_LOG_UPDATES = ["finished_at_utc", "status", "ticker_count", "raw_headlines_collected",
                   "scored_headlines", "insights_generated", "trades_executed", "error_message",
                   "summary_json"]


def report_run_rows(metrics: DataFrame, report_name: str, output_dir: str, now: Column) -> DataFrame:
    """One row per metrics row, the metrics themselves as JSON."""
    return metrics.select(
        F.lit(report_name).alias("report_name"), "period_start", "period_end", now.alias("generated_at_utc"),
        F.lit(output_dir).alias("output_dir"), F.to_json(F.struct(*metrics.columns)).alias("metrics_json"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive schema: declared columns that are absent come as NULL, extra ones stay."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns]
    return df.select("*", *missing)


# ---------------------------------------------------------------- checks


def null_violations(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One row per column: how many NULLs. All rules in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])
    return counted.select(F.lit(table).alias("table"), F.explode(pairs).alias("_p")).select("table", "_p.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def broken_references(store: Tables, references: Iterable[tuple[str, str, str, str]] = tuple(schemas.REFERENCES)) -> DataFrame:
    """(child, column, parent, orphans): rows of each declared reference whose parent is missing.

    Children are counted by reference first, before the shuffle, so what meets the parents is one row per key, however
    many rows refer to it; parents are one row per key as well.
    """
    found = None
    for child, column, parent, parent_column in references:
        refs = store.read(child).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        known = store.read(parent).select(F.col(parent_column).alias("_key")).distinct()
        lost = refs.join(known, "_key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        row = lost.select(F.lit(child).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "orphans")
        found = row if found is None else found.unionByName(row)
    return found


# ---------------------------------------------------------------- files

DAY = "published_day"  # partition column of the day-partitioned tables
PART = "part"  # of all others: the day in their key, or one of BUCKETS parts by the hash of the key
BUCKETS = 16
#: Batches of so many keys at most are sent to the stored rows; larger ones are joined by shuffling both.
SMALL_BATCH = 100_000


def _observed(observation: Observation) -> int:
    """Rows that passed; none where the optimizer took the observed step out, because nothing can pass it."""
    try:
        return observation.get["rows"]
    except Py4JJavaError as error:
        if "AssertionError" in str(error.java_exception):  # no figures for this observation
            return 0
        raise


class Tables:
    """Parquet tables under one root folder, limited to the declared names.

    Each change is a commit (see ``versions``); those made in a ``transaction`` are one commit. Writes return the
    number of rows they saved, counted while they were written.
    """

    def __init__(self, spark: SparkSession, root: str, allowed: Mapping[str, T.StructType] = schemas.TABLES):
        self.spark, self.root, self.allowed = spark, root.rstrip("/"), dict(allowed)
        self.versions = Versions(spark, self.root)
        self._open: dict | None = None

    # ------------------------------------------------------------ state

    def _state(self) -> dict:
        return self._open if self._open is not None else self.versions.newest()

    def _set(self, state: dict) -> None:
        if self._open is not None:
            self._open = state
        else:
            self.versions.commit(state)

    @contextmanager
    def transaction(self) -> Iterator[Tables]:
        """Changes inside become visible to others together at the end, or not at all if it fails."""
        if self._open is not None:
            raise RuntimeError("a transaction is open already")
        self._open = before = self.versions.newest()
        try:
            yield self
            if self._open is not before:
                self.versions.commit(self._open)
        finally:
            self._open = None
            self.versions.drop_steps()

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that a commit holds; -1 before the first."""
        return self._state()["batches"].get(stream, -1)

    def note_batch(self, stream: str, batch: int) -> None:
        state = copy.deepcopy(self._state())
        state["batches"][stream] = batch
        self._set(state)

    # ------------------------------------------------------------ layout

    def _check(self, name: str) -> None:
        if name not in self.allowed:
            raise ValueError(f"table {name!r} is not one of {sorted(self.allowed)}")

    def _partition(self, name: str) -> tuple[str, Column]:
        """Partition column of a table and its value."""
        if name in schemas.DAY_PARTITIONED:
            return DAY, F.col(schemas.DAY_PARTITIONED[name]).cast("date")
        if name in schemas.KEY_DAYS:
            return PART, F.coalesce(F.col(schemas.KEY_DAYS[name]).cast("date").cast("string"), F.lit("none"))
        keys = schemas.NATURAL_KEYS.get(name)
        if keys is None:
            return PART, F.lit("all")
        hashed = F.xxhash64(*[F.col(k).cast("string") for k in keys])
        return PART, F.concat(F.lit("b"), F.pmod(hashed, F.lit(BUCKETS)).cast("string"))

    def schema(self, name: str) -> T.StructType:
        fields = list(self.allowed[name].fields)
        if name in schemas.DAY_PARTITIONED:
            fields.append(T.StructField(DAY, T.DateType()))
        return T.StructType(fields)

    def read(self, name: str, every_column: bool = False, only: set[str] | None = None) -> DataFrame:
        """The newest version, by its declared schema: no file is opened to plan the scan, and
        columns that older files lack are NULL. ``every_column`` adds undeclared columns, at the
        price of reading all file footers; ``only`` reads some partition folders."""
        self._check(name)
        declared = self.schema(name)
        paths = self.versions.paths(self._state(), name, only)
        if not paths:
            return self.spark.createDataFrame([], declared)
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        if every_column:
            found = reader.option("mergeSchema", "true").parquet(*paths).drop("write", PART)
            return conform(found, declared)
        inner = [T.StructField("write", T.StringType())] + ([] if DAY in declared.fieldNames() else [T.StructField(PART, T.StringType())])
        return reader.schema(T.StructType([*declared.fields, *inner])).parquet(*paths).select(*declared.fieldNames())

    # ------------------------------------------------------------ writes

    def _write(self, name: str, df: DataFrame) -> tuple[str, int]:
        """A new write folder with rows brought together by partition, large ones split by size; and how many rows."""
        column, value = self._partition(name)
        write, saved = "w" + uuid.uuid4().hex, Observation()
        rows = df.withColumn(column, value).observe(saved, F.count(F.lit(1)).alias("rows")).hint("rebalance", column)
        rows.write.mode("error").partitionBy(column).parquet(self.versions.folder(name, write))
        return write, _observed(saved) if self.versions.partitions(name, write) else 0

    def stage(self, df: DataFrame) -> DataFrame:
        """Written beside the tables and read again, so that what several writes need is made once. Gone when the
        transaction ends."""
        path = self.versions.step()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, name: str, df: DataFrame) -> int:
        self._check(name)
        write, saved = self._write(name, df)
        state = copy.deepcopy(self._state())
        state["tables"][name] = {write: None} if self.versions.partitions(name, write) else {}
        self._set(state)
        return saved

    def append(self, name: str, df: DataFrame) -> int:
        self._check(name)
        write, saved = self._write(name, df)
        if self.versions.partitions(name, write):
            state = copy.deepcopy(self._state())
            state["tables"].setdefault(name, {})[write] = None
            self._set(state)
        return saved

    def rewrite(self, name: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Copy on write: ``merge(stored, changes)`` replaces the partitions that the changes touch; the files of all
        others stay as they are. Returns the rows written."""
        self._check(name)
        column, value = self._partition(name)
        changes = self.stage(changes)  # needed twice
        touched = {self._folder_of(column, r[0]) for r in changes.select(value.alias("v")).distinct().collect()}  # days, or BUCKETS
        if not touched:
            return self._done(0)
        merged = merge(self.read(name, every_column=True, only=touched), changes)
        write, saved = self._write(name, merged)
        state = self.versions.without(self._state(), name, touched)
        if self.versions.partitions(name, write):
            state["tables"][name][write] = None
        self._set(state)
        return self._done(saved)

    def drop_steps(self) -> None:
        """Deletes what was staged; inside a transaction that is left to its end."""
        if self._open is None:
            self.versions.drop_steps()

    def _done(self, saved: int) -> int:
        self.drop_steps()
        return saved

    @staticmethod
    def _folder_of(column: str, value: object) -> str:
        return f"{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"

    def absent(self, name: str, batch: DataFrame, order: Sequence[Column] = ()) -> tuple[DataFrame, int, int]:
        """(rows whose key the table lacks, one per key; rows of the batch; distinct keys of the batch).

        On day-partitioned tables only the days of the batch are read (its set of days, not the span): the key contains
        the timestamp, so a copy can only be on the same day, or among the rows without a day. Keys of a small batch
        are sent to the stored rows, so that those are not shuffled."""
        self._check(name)
        keys = schemas.NATURAL_KEYS[name]
        column, value = self._partition(name)
        touched = batch.groupBy(value.alias("v")).agg(  # calendar days, or BUCKETS; a key is in one of them
            F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*keys)).alias("unique")).collect()
        fetched, unique = (sum(r[c] for r in touched) for c in ("rows", "unique"))
        stored = self.read(name, only={self._folder_of(column, r["v"]) for r in touched})
        met = keys_met(stored, batch, keys, unique <= SMALL_BATCH)
        one_each = first_rows(batch, keys, [*order, *_by_values(batch)])
        return one_each.join(met, list(keys), "left_anti"), fetched, unique

    def insert_if_absent(self, name: str, batch: DataFrame, order: Sequence[Column] = ()) -> LoadCounts:
        """Appends the rows whose key is new. Rows and keys are counted while their partitions are found, what is saved
        while it is written."""
        fresh, fetched, unique = self.absent(name, batch, order)
        return LoadCounts(fetched, unique, self.append(name, fresh))

    def upsert(self, name: str, updates: DataFrame, update_columns: Sequence[str] | None = None,
               batch_order: str | None = None) -> int:
        keys = schemas.NATURAL_KEYS[name]
        return self.rewrite(name, updates, lambda stored, new: upsert(stored, new, keys, update_columns, batch_order))

    def upsert_positions(self, updates: DataFrame, batch_order: str | None = None) -> int:
        """Stored form of ``upsert_positions``: positions without quantity go."""
        return self.rewrite("portfolio_positions", updates, lambda stored, new: upsert_positions(stored, new, batch_order))

    def resolve_alerts(self, alert_types: Iterable[str]) -> None:
        """Stored form of ``resolve_alerts``: only partitions with such an open alert are rewritten."""
        types = list(alert_types)
        hit = self.read("health_alerts").where((F.col("status") == "open") & F.col("alert_type").isin(types))
        self.rewrite("health_alerts", hit, lambda stored, _: resolve_alerts(stored, types))

    def empty(self, names: Iterable[str]) -> dict[str, int]:
        """Empties tables and reports how many rows each had."""
        removed = {}
        for name in names:
            removed[name] = self.read(name).count()
            self.replace(name, self.spark.createDataFrame([], self.allowed[name]))
        return removed


PORTFOLIO_TABLES = ["portfolio_trades", "portfolio_positions", "portfolio_snapshots", "portfolio_runs"]


def export_csv(frames: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder with header per frame. Nested columns become JSON text."""
    paths = {}
    for name, frame in frames.items():
        flat = frame.select([
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name) for f in frame.schema.fields])
        paths[name] = f"{folder.rstrip('/')}/{name}.csv"
        flat.write.mode("overwrite").csv(paths[name], header=True)
    return paths
