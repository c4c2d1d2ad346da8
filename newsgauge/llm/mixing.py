"""Mixing sources to target weights: multinomial counts a shard, permuted block indices, a join by index.

Built-in functions only. The words of a source form one stream, cut into blocks of fixed length; a document's place in
it comes from sums of counts, so no source is ever in one task. Every slot of an output shard draws a source with the
probability of its share, so a shard's counts are multinomial; what a source draws beyond its quota goes to the
sources that are short of theirs. The k-th slot of a source takes the block that a pseudorandom permutation of the
source's indices maps k to, one permutation for each time through the source, and slots and blocks meet in a join.

Sources are a recipe: one row a source goes through one task, and the list travels with the plan (``MOST_SOURCES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.shared import staged

WORD = "[^\\x20\\x09-\\x0D]+"
#: Members of a group whose sums are added up in one window; groups of groups are added up the same way.
GROUP = 512
MOST_SOURCES = 1 << 16
ROUNDS = 12
SLOTS_A_TASK = 8192


def draw(*parts: Column | str) -> Column:
    """A pseudorandom number below 2^60 from the text of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A permutation of 0..size-1 for each ``key``, by swap-or-not rounds: each swaps some pairs i, c - i."""

    def swapped(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(draw(key, r), size) - x, size)
        return F.when(F.pmod(draw(key, r, F.lit("swap"), F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index.cast("bigint"), swapped)


def sums_before(counts: DataFrame, key: str, place: str, value: str, levels: int = 3) -> DataFrame:
    """``counts`` (one row for each key and place) with ``before``: the sum of ``value`` at the key's earlier places.

    Places are added up in groups of GROUP, groups in groups of groups; a window sees GROUP rows of a key, the topmost
    one a row for GROUP^(levels-1) places.
    """
    if levels == 1:
        window = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum(value).over(window), F.lit(0)))
    own = f"_group{levels}"
    grouped = counts.withColumn(own, F.floor(F.col(place) / GROUP))
    groups = grouped.groupBy(key, own).agg(F.sum(value).alias("_sum"))
    skipped = sums_before(groups, key, own, "_sum", levels - 1).select(key, own, F.col("before").alias("_skip"))
    window = Window.partitionBy(key, own).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return (grouped.withColumn("_inside", F.coalesce(F.sum(value).over(window), F.lit(0))).join(skipped, [key, own])
            .withColumn("before", F.col("_skip") + F.col("_inside")).drop("_skip", "_inside", own))


def catalog(sources: DataFrame, weights: tuple[float, ...], share: float, most_epochs: int) -> DataFrame:
    """(source, size) with index, target and wanted (whole words): shares of ``share`` times all words by weight.

    A source gives at most ``most_epochs`` times its words; sorted by how soon they reach that, the sources at their
    limit are those before the first that the rest of the total, dealt by weight, leaves below its own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (sources.withColumn("index", F.row_number().over(by_name) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("index", F.lit(len(weights))) + 1).cast("int")))
              .withColumn("limit", (F.col("size") * most_epochs).cast("double"))
              .withColumn("total", F.sum("size").over(everything) * F.lit(float(share))))
    soonest = Window.orderBy(F.col("limit") / F.col("weight"), "index")
    dealt = (ranked.withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             .withColumn("weights", F.sum("weight").over(soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
             .withColumn("free", F.col("rest") * F.col("weight") / F.col("weights") < F.col("limit")))
    first = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "index", "rest", "weights"))).over(everything)
    share_of_rest = F.col("first.rest") * F.col("weight") / F.col("first.weights")
    return (dealt.withColumn("first", first)
            .withColumn("target", F.least("limit", F.coalesce(share_of_rest, F.col("limit"))))
            .withColumn("wanted", F.round("target").cast("bigint"))
            .select("source", F.col("index").cast("int").alias("index"), "size", "target", "wanted"))


def _recipe(sources: DataFrame, block: int) -> DataFrame:
    """The catalog with blocks, full_blocks and quota (slots of a source)."""
    size, wanted = F.col("size"), F.col("wanted")
    rounds = F.when(size > 0, F.floor(wanted / size)).otherwise(0)
    return (sources.withColumn("blocks", F.ceil(size / block)).withColumn("full_blocks", F.floor(size / block))
            .withColumn("quota", rounds * F.col("blocks") + F.ceil((wanted - rounds * size) / block)))



def _interval(starts: Column, count: Column, value: Column) -> Column:
    """Index of the last of ``count`` ascending starts that is not above ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_SOURCES.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step < count) & (F.get(starts, low + step) <= value), low + step).otherwise(low))


def _lists(recipe: DataFrame, columns: list[str]) -> Column:
    """The recipe's columns as one struct of arrays in index order: a value of the plan, bounded by MOST_SOURCES."""
    rows = recipe.agg(F.sort_array(F.collect_list(F.struct("index", *columns))).alias("rows"))
    return rows.select(F.struct(*[F.col(f"rows.{c}").alias(c) for c in columns]).alias("lists")).scalar()


class Mix:
    """The plan of a mix: ``documents`` (placed), ``sources`` (catalog) and ``slots`` of the output."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...], share: float, most_epochs: int, block: int, shard: int,
                 seed: int, id_col: str, text_col: str, source_col: str):
        spark = docs.sparkSession
        self.block = block
        text = docs[text_col].cast("string")
        rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[source_col].cast("string").alias("source"),
                           F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
        sized = staged(rows, "sizes")
        groups = sized.count() // GROUP + 1
        grouped = sized.withColumn("group", F.pmod(draw(F.lit(f"{seed}:group"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(groups)))
        # A null source and the source '' differ, so windows and joins use the index from here on.
        sums = staged(grouped.groupBy("source", "group").agg(F.sum("size").alias("words")), "sums")
        totals = sums.groupBy("source").agg(F.sum("words").alias("size"))
        self.sources = sources = staged(_recipe(catalog(totals, weights, share, most_epochs), block), "sources")
        n_sources = sources.count()
        if n_sources > MOST_SOURCES:
            raise ValueError(f"{n_sources} sources: a mix is a recipe of at most {MOST_SOURCES}")
        indexed = sums.join(sources.select(F.col("source").alias("_source"), "index"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        starts = sums_before(indexed.select("index", "group", "words", "source"), "index", "group", "words").withColumnsRenamed({"before": "base", "source": "_source", "group": "_group"})
        inside = Window.partitionBy("source", "group").orderBy(F.col("doc_id").asc_nulls_last(), "size")
        placed = (grouped.withColumn("place", F.row_number().over(inside))
                  .withColumn("offset", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
        self.documents = (placed.join(starts.select("_source", "_group", "index", "base"),
                                      F.col("source").eqNullSafe(F.col("_source")) & (F.col("group") == F.col("_group")))
                          .select("doc_id", "source", "index", "group", "place", "size", (F.col("base") + F.col("offset")).alias("start")))
        self.slots = self._slots(spark, sources, shard, seed)

    def _slots(self, spark, recipe: DataFrame, shard: int, seed: int) -> DataFrame:
        """shard, slot, index, epoch, block, take: the block that each slot of the output takes, and how many of its words."""
        total = recipe.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
        n_sources = recipe.count()
        order = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
        shares = _lists(recipe.withColumn("from", F.coalesce(F.sum("quota").over(order), F.lit(0))), ["from"])
        count = F.lit(n_sources)
        drawn = (spark.range(total).withColumn("u", F.pmod(draw(F.lit(f"{seed}:slot"), F.col("id").cast("string")), F.lit(max(1, total))))
                 .withColumn("lists", shares)
                 .select(F.floor(F.col("id") / shard).alias("shard"), F.col("id").alias("slot"), _interval(F.col("lists.from"), count, F.col("u")).alias("drew")))
        counts = staged(drawn.groupBy("drew", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")
        drew = counts.groupBy("drew").agg(F.sum("n").alias("draws"))
        settled = staged(recipe.join(drew, recipe["index"] == drew["drew"], "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
                         .withColumn("over", F.coalesce(F.sum(F.greatest(F.lit(0), F.col("draws") - F.col("quota"))).over(order), F.lit(0)))
                         .withColumn("short", F.coalesce(F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("draws"))).over(order), F.lit(0))), "settled")
        inside = Window.partitionBy("shard", "drew").orderBy("slot")
        before = sums_before(counts, "drew", "shard", "n").select("drew", "shard", "before")
        of_drew = F.broadcast(settled.select(F.col("index").alias("drew"), F.col("quota").alias("_quota"), F.col("over").alias("_over")))  # MOST_SOURCES rows
        ranked = (drawn.select("shard", "slot", "drew").withColumn("rank", F.row_number().over(inside) - 1).join(before, ["drew", "shard"])
                  .join(of_drew, "drew").withColumn("k", F.col("before") + F.col("rank")))
        beyond = F.col("k") >= F.col("_quota")
        chosen = (ranked.withColumn("surplus", F.when(beyond, F.col("_over") + F.col("k") - F.col("_quota")))
                  .withColumn("lists", _lists(settled, ["short"]))
                  .withColumn("index", F.when(beyond, _interval(F.col("lists.short"), count, F.col("surplus"))).otherwise(F.col("drew")).cast("int")))
        of_index = F.broadcast(settled.select("index", "size", "wanted", "blocks", "full_blocks", "draws", "short"))
        dealt = (chosen.join(of_index, "index")
                 .withColumn("k", F.when(F.col("surplus").isNotNull(), F.col("draws") + F.col("surplus") - F.col("short")).otherwise(F.col("k"))))
        # The short last block of a source is always the last one of its epoch.
        timed = dealt.select("shard", "slot", "index", "size", "wanted", "full_blocks", F.floor(F.col("k") / F.col("blocks")).alias("epoch"),
                             F.pmod("k", "blocks").alias("turn"))
        spread = timed.repartition(total // SLOTS_A_TASK + 1, "slot")  # permuting takes longer than its bytes tell
        key = F.concat_ws(":", F.lit(f"{seed}:block"), F.col("index").cast("string"), F.col("epoch").cast("string"))
        block = F.when(F.col("turn") < F.col("full_blocks"), permuted(F.col("turn"), F.col("full_blocks"), key)).otherwise(F.col("turn"))
        left = F.col("wanted") - F.col("epoch") * F.col("size") - F.col("turn") * self.block
        return (spread.withColumn("block", block)
                .select("shard", "slot", "index", "epoch", "block", F.least(left, F.lit(self.block)).alias("take")))

    def pieces(self) -> DataFrame:
        """One row for each document and block that holds words of it: where they are in the block and the document."""
        last = F.floor((F.col("start") + F.col("size") - 1) / self.block)
        first = F.floor(F.col("start") / self.block)
        in_blocks = F.when(F.col("size") > 0, F.sequence(first, last))
        cut = self.documents.withColumn("block", F.explode_outer(in_blocks))
        begin = F.greatest(F.lit(0), F.col("start") - F.col("block") * self.block)
        end = F.least(F.lit(self.block), F.col("start") + F.col("size") - F.col("block") * self.block)
        return (cut.withColumn("at", begin).withColumn("words", end - begin)
                .withColumn("first_word", F.col("block") * self.block + F.col("at") - F.col("start")))


def _mix(docs: DataFrame, weights, share, most_epochs, block, shard, seed, id_col, text_col, source_col) -> Mix:
    return Mix(docs, tuple(weights), share, most_epochs, block, shard, seed, id_col, text_col, source_col)


def mix_shares(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, block: int = 1024,
               shard: int = 1024, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target (words of its source in the mix), taken.

    Sources take the ``weights`` in turn, by code point, a null source last; ``taken`` counts the words of the document
    in the mix, repeats included. Null, empty and white texts have no words and nothing of them is taken; a source
    without words has the target 0. Rows that repeat an id, or have none, are documents of their own; which of two
    rows with one id stands first depends on their sizes alone. Other columns are ignored, an empty table gives no row.
    """
    mix = _mix(docs, weights, share, most_epochs, block, shard, seed, id_col, text_col, source_col)
    used = mix.slots.groupBy("index", "block").agg(F.collect_list("take").alias("takes"))  # one for each epoch
    gain = F.aggregate(F.coalesce("takes", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"),
                       lambda s, take: s + F.greatest(F.lit(0), F.least(F.col("words"), take - F.col("at"))))
    taken = (mix.pieces().join(used, ["index", "block"], "left").withColumn("gain", gain)
             .groupBy("index", "group", "place").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("gain").alias("taken")))
    return (taken.join(mix.sources.select("index", F.col("size").alias("source_size"), "target"), "index")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, block: int = 1024,
                 shard: int = 1024, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, one row per slot: shard, slot, source, epoch, block, doc_ids, text (words joined by one space).

    Texts are cut to their pieces before they meet the slots. Documents must have ids of their own here, because texts
    are joined to their places by id; those without one are left out.
    """
    mix = _mix(docs.filter(docs[id_col].isNotNull()), weights, share, most_epochs, block, shard, seed, id_col, text_col, source_col)
    words = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.regexp_extract_all(docs[text_col].cast("string"), F.lit(WORD), F.lit(0)).alias("_all"))
    cut = (mix.pieces().filter("words > 0").join(words, "doc_id")
           .select("index", "block", "at", "words", "doc_id", F.slice("_all", F.col("first_word").cast("int") + 1, F.col("words").cast("int")).alias("_own")))
    blocks = cut.groupBy("index", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "_own"))).alias("parts"))
    inside = F.filter("parts", lambda p: p["at"] < F.col("take"))
    return (mix.slots.join(blocks, ["index", "block"]).join(mix.sources.select("index", "source"), "index")
            .select("shard", "slot", "source", "epoch", "block", F.transform(inside, lambda p: p["doc_id"]).alias("doc_ids"),
                    F.array_join(F.slice(F.flatten(F.transform("parts", lambda p: p["_own"])), 1, F.col("take").cast("int")), " ").alias("text")))
