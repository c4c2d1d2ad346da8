"""Exact duplicates by sorting content: range partitions of the normalised text, neighbours compared in full.

Built-in functions only. A text's sort key is its first letters, its SHA-256 and a salt; splitters are sampled from
these short keys, so the sample stays small whatever the texts are. Inside a range Spark's external sort orders by
the whole normalised text and id; a window over equal neighbours keeps the smallest id. The ``SPREAD`` largest groups
are salted by id so that no group fills one range; their parts are put together from counts that were summed before
the shuffle. Every other group holds less than 1/``SPREAD`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.shared import WHITE

#: So many groups, the largest ones, are salted; the list of them is what is broadcast (40 bytes a group).
SPREAD = 256
#: Rows of a salted group that share a salt, about.
ROWS_PER_SALT = 2048
LEAD = 24


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _neighbours(docs: DataFrame, id_col: str, text_col: str, payload: list[str]) -> DataFrame:
    """row (the payload), doc_id, keep_id, group_size, kept, sha."""
    text = docs[text_col].cast("string")
    keyed = (docs.select(F.struct(text.alias("text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(payload)]).alias("row"),
                         docs[id_col].cast("bigint").alias("doc_id"), normal_text(text).alias("normal"))
             .select("doc_id", "row", F.unhex(F.sha2("normal", 256)).alias("sha"), F.substring("normal", 1, LEAD).alias("lead")))
    large = (keyed.groupBy("sha").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("smallest"))
             .filter(F.col("size") > ROWS_PER_SALT).orderBy(F.desc("size"), "sha").limit(SPREAD))
    salts = F.ceil(F.col("size") / ROWS_PER_SALT)
    ranged = (keyed.join(F.broadcast(large), "sha", "left")
              .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), salts), F.lit(0)))
              .repartitionByRange("lead", "sha", "salt"))
    same = Window.partitionBy("lead", "sha", "salt", "normal")
    ordered = same.orderBy(F.col("doc_id").asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = (ranged.withColumn("normal", normal_text(F.col("row.text")))
            .select("doc_id", "row", "sha", "size", "smallest", F.row_number().over(ordered).alias("place"),
                    F.first("doc_id").over(whole).alias("head"), F.count(F.lit(1)).over(whole).alias("near")))
    in_large = F.col("size").isNotNull()
    keep = F.when(in_large, F.col("smallest")).otherwise(F.col("head"))
    return near.select(
        "row", "doc_id", keep.alias("keep_id"), F.when(in_large, F.col("size")).otherwise(F.col("near")).alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "sha")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. The smallest
    id of a group stays; null ids come last, so keep_id is null only where a group has no id. Of repeated rows with
    the id that stays, one is kept. Other columns are ignored. An empty table gives an empty result.
    """
    return _neighbours(docs, id_col, text_col, []).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, unchanged; they travel with the sort, once."""
    kept = _neighbours(docs, id_col, text_col, docs.columns).filter("kept")
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
