"""What the operators share: the shared folder, staged tables, text rules and sliced Arrow batches."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space, tab to carriage return.
WHITE = "[\\x20\\x09-\\x0D]+"
WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Python code works on at most this many bytes of text at a time (a longer text makes a slice of its own).
SLICE_BYTES = 6 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage and survives lost executors. What the write shuffled goes
    when it is done."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    spark.conf.set(CLEANUP, "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_in_process(name: str, source: object, make: Callable) -> object:
    """``make(source)``, the last one of a name kept while the worker process lives.

    Functions travel to workers by value, so that these need not have this package installed; their globals are then new
    in every task, and a cache there would be too.
    """
    kept = sys.modules.setdefault("_llm_kept", ModuleType("_llm_kept")).__dict__
    if name not in kept or kept[name][0] != source:
        kept[name] = (source, make(source))
    return kept[name][1]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under its own names, so that others cannot clash."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def crc_of_id(id_column: Column) -> Column:
    """crc32 of the decimal text of an id (of '' for a null id)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece stays near ``limit`` bytes."""
    for batch in batches:
        sizes = _lengths(batch.column(column))
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets start at 0."""
    lengths = _lengths(column)
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, dtype=np.uint8), offsets
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], dtype=width)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
    if len(data) == offsets[-1]:
        return data, offsets
    kept = [data[a - at[0]:a - at[0] + n] for a, n in zip(at[:-1].tolist(), lengths.tolist(), strict=True) if n]
    return np.concatenate(kept), offsets
