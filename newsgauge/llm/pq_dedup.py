"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, asymmetric distances, exact rerank.

The coarse lists and the codebooks are fitted on FIT_VECTORS vectors at most; every vector is indexed. Probes are
sufficient: a list is left out only if its cell lies further from the vector than two linked vectors can be apart.
A table-lookup distance rules a candidate out only if it is above that by more than the code's own error. So both
steps lose no link, and what is left is compared by cosine in double precision.

A cell (label, list) is cut into blocks of about BLOCK vectors; a task sees one block against one block, counts links
at both ends and returns a spanning forest of them, never all pairs. Two lists are compared once, from the lower one.
Equal vectors of a label are one vector with a number; ids come in only at the end, so they may repeat or be null.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.graph import components
from newsgauge.llm.shared import staged

FIT_VECTORS = 16_384
MOST_LISTS = 4_096
SUBSPACES, CODES = 8, 64
BLOCK = 2_048
ROUNDS = 8
#: The list of cells travels with the joins while there are so many at most (40 bytes each).
FEW_CELLS = 65_536
_SLACK = 1e-6


class Index(NamedTuple):
    """Of the vectors of one length: list centres, and code centres by subspace."""

    centres: np.ndarray
    parts: list[np.ndarray]
    codes: list[np.ndarray]


def _means(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means centres."""
    draw = np.random.default_rng(seed)
    centres = points[np.sort(draw.choice(len(points), min(count, len(points)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = _squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, lists: int) -> Index:
    points = unit(sample)
    centres = _means(points, max(1, min(lists, len(points) // 16)), 1)
    rest = points - centres[_squares(points, centres).argmin(axis=1)]
    parts = [x for x in np.array_split(np.arange(points.shape[1]), min(SUBSPACES, points.shape[1])) if len(x)]
    return Index(centres, parts, [_means(rest[:, p], CODES, 2 + k) for k, p in enumerate(parts)])


def _index_of(sample: dict[int, list], lists: int) -> dict[int, tuple]:
    """Plain tuples: what is broadcast is unpickled where this package need not be installed."""
    return {size: tuple(fit(np.array(rows, dtype=np.float64), lists)) for size, rows in sample.items()}


def assign(index: Index, points: np.ndarray, reach: float):
    """(own list, codes, error of the code, mask of lists to probe) of unit vectors. Linked ones are ``reach`` apart at most."""
    squares = _squares(points, index.centres)
    own = squares.argmin(axis=1)
    rest = points - index.centres[own]
    codes = np.stack([_squares(rest[:, p], c).argmin(axis=1) for p, c in zip(index.parts, index.codes, strict=True)], 1).astype(np.uint8)
    coded = np.concatenate([c[codes[:, k]] for k, c in enumerate(index.codes)], 1)
    error = np.sqrt(((rest - coded) ** 2).sum(axis=1))
    # distance to the plane between the own list's centre and another's bounds that to the other's cell from below
    apart = 2 * np.sqrt(_squares(index.centres[own], index.centres))
    beyond = squares - squares.min(axis=1, keepdims=True)
    return own, codes, error, beyond <= (reach + _SLACK) * np.maximum(apart, _SLACK)


def block_links(index: Index | None, which: int, queries: np.ndarray, base: np.ndarray, codes: np.ndarray, errors: np.ndarray,
                query_keys: np.ndarray, base_keys: np.ndarray, query_times: np.ndarray, base_times: np.ndarray, home: np.ndarray,
                threshold: float, reach: float):
    """(links of each query, links of each base vector, pairs of a spanning forest of the links).

    Links count as often as the vector at their other end stands in the table. ``home`` tells queries of the base's own
    list: their links are found from both sides, those of the others from here only.
    """
    links, back, edges = np.zeros(len(queries), dtype=np.int64), np.zeros(len(base), dtype=np.int64), []
    label = np.arange(len(base))  # connected parts of the base found so far
    for a in range(0, len(queries), 256):
        some = queries[a:a + 256]
        if index is None:
            near = np.ones((len(some), len(base)), dtype=bool)
        else:
            rest = some - index.centres[which]
            far = sum(_squares(rest[:, p], c)[:, codes[:, k]] for k, (p, c) in enumerate(zip(index.parts, index.codes, strict=True)))
            near = np.sqrt(far) <= reach + errors[None] + _SLACK
        near &= query_keys[a:a + 256, None] != base_keys[None]
        rows, columns = np.nonzero(near)
        if len(rows) * 4 > near.size:
            near &= some @ base.T >= threshold
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", some[rows[k:k + 50_000]], base[columns[k:k + 50_000]])
                                    for k in range(0, len(rows), 50_000)] or [np.zeros(0)])
            near = np.zeros_like(near)
            near[rows[exact >= threshold], columns[exact >= threshold]] = True
        links[a:a + 256] = near @ base_times
        away = ~home[a:a + 256]
        back += query_times[a:a + 256][away] @ near[away]
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            found = np.flatnonzero(near[row])
            parts, first = np.unique(label[found], return_index=True)
            edges += [(int(query_keys[a + row]), int(base_keys[found[k]])) for k in first]
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
    return links, back, edges


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are compared only with equal, non-null labels and equal lengths. Those that are null, empty or zero, or
    hold null or non-finite components, link with nothing: no links, their own component, kept. Rows with equal
    vectors are linked; rows that repeat an id are vectors of their own, whatever their vectors and labels are. A null id
    counts as a link of others; a component's id is its smallest non-null one, or null.
    """
    spark = vectors.sparkSession
    own = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"),
                         vectors[label_col].cast("string").alias("label"))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0)
                      & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = own.filter(fine)
    single = "float" in vectors.schema[vector_col].dataType.simpleString()
    kind = np.float32 if single else np.float64  # vectors travel as they came
    grouped = good.groupBy("label", "vector").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("times"))
    classes = staged(grouped.withColumn("key", F.monotonically_increasing_id()), "vectors")  # numbers hold from here on: they are stored
    total = classes.count()
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    sample: dict[int, list] = {}
    for row in classes.orderBy(F.xxhash64("label", "vector"), "label").limit(FIT_VECTORS).select("vector").toLocalIterator():
        sample.setdefault(len(row["vector"]), []).append(row["vector"])
    shared = spark.sparkContext.broadcast(_index_of(sample, min(MOST_LISTS, math.ceil(math.sqrt(total) / 4) or 1)))

    def index(batches):
        for batch in batches:
            values = batch.column("vector")
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False)
            begin = np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                raw = flat[(begin[mine][:, None] + np.arange(size)).ravel()].reshape(len(mine), size)
                points = unit(raw)
                if size not in shared.value:
                    lists, codes, error, probes = np.zeros(len(mine), dtype=np.int64), np.zeros((len(mine), 1), dtype=np.uint8), np.zeros(len(mine)), np.ones((len(mine), 1), dtype=bool)
                else:
                    lists, codes, error, probes = assign(Index(*shared.value[size]), points, reach)
                    probes &= np.arange(probes.shape[1]) >= lists[:, None]  # of two lists the lower one asks
                take = pa.array(mine)
                yield pa.RecordBatch.from_pydict({
                    "label": batch.column("label").take(take), "key": batch.column("key").take(take), "times": batch.column("times").take(take),
                    "size": pa.array(np.full(len(mine), size, dtype=np.int32)), "list": pa.array(lists.astype(np.int32)),
                    "probes": pa.array([np.flatnonzero(x).astype(np.int32) for x in probes], pa.list_(pa.int32())),
                    "code": pa.array([x.tobytes() for x in codes], pa.binary()), "error": pa.array(error),
                    "point": pa.array([x.tobytes() for x in raw.astype(kind)], pa.binary())})

    indexed = staged(classes.mapInArrow(index, "label string, key long, times long, size int, list int, probes array<int>, "
                                               "code binary, error double, point binary"), "indexed")
    cell = ["label", "size", "list"]
    blocks = staged(indexed.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    if blocks.count() <= FEW_CELLS:
        blocks = F.broadcast(blocks)

    def block(salt: int):
        return F.pmod(F.xxhash64("key", F.lit(salt)), F.col("blocks")).cast("int")

    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    role = ["base", "home", "key", "times", "code", "error", "point"]
    base = (indexed.drop("probes").join(blocks, cell).withColumn("b", block(1)).withColumn("q", every)
            .withColumns({"base": F.lit(True), "home": F.lit(True)}).select(*cell, "b", "q", *role))
    queries = (indexed.withColumnRenamed("list", "own").withColumn("list", F.explode("probes")).join(blocks, cell)
               .withColumn("q", block(2)).withColumn("b", every)
               .withColumns({"base": F.lit(False), "home": F.col("list") == F.col("own"), "code": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})
               .select(*cell, "b", "q", *role))

    def compare(table: pa.Table) -> pa.Table:
        is_base = table.column("base").to_numpy()
        size, which = table.column("size")[0].as_py(), table.column("list")[0].as_py()
        asked, held = table.filter(pa.array(~is_base)), table.filter(pa.array(is_base))

        def matrix(part: pa.Table, name: str, item) -> np.ndarray:
            chosen = part.column(name).to_pylist()
            return np.frombuffer(b"".join(chosen), dtype=item).reshape(len(chosen), -1)

        keys, counts, a, b = [], [], [], []
        if asked.num_rows and held.num_rows:
            known = Index(*shared.value[size]) if size in shared.value else None
            q, h = (part.column("key").to_numpy() for part in (asked, held))
            links, back, edges = block_links(
                known, which, unit(matrix(asked, "point", kind).astype(np.float64)), unit(matrix(held, "point", kind).astype(np.float64)),
                matrix(held, "code", np.uint8), held.column("error").to_numpy(), q, h, asked.column("times").to_numpy(),
                held.column("times").to_numpy(), asked.column("home").to_numpy(), threshold, reach)
            for own, n in ((q, links), (h, back)):
                keys.append(own[n > 0])
                counts.append(n[n > 0])
            a, b = ([e[k] for e in edges] for k in (0, 1))
        n_links = sum(map(len, keys))
        return pa.table({
            "key": pa.array(np.concatenate([*keys, np.array(a, dtype=np.int64)]) if keys else np.zeros(0, dtype=np.int64)),
            "links": pa.array(np.concatenate([*counts, np.zeros(len(a), dtype=np.int64)]) if keys else np.zeros(0, dtype=np.int64)),
            "other": pa.concat_arrays([pa.nulls(n_links, pa.int64()), pa.array(np.array(b, dtype=np.int64))])})

    # dealt out by block pair: a hot cell is many pairs
    dealt = base.unionByName(queries).repartition(*cell, "b", "q")
    found = staged(dealt.groupBy(*cell, "b", "q").applyInArrow(compare, "key long, links long, other long"), "found")
    links = found.filter("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    members = classes.select("key", "smallest").join(linked.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    told = (classes.join(links, "key", "left").join(members.select("key", "component"), "key").join(named, "component")
            .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    linked_rows = good.join(told, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = own.filter(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", kept)
