"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.session import ensure_checkpoint_dir


def small_batches(spark: SparkSession) -> None:
    """Batches of texts for Python hold at most 1 MB (Spark's default is 64 MB, or 10,000 texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that several jobs read one result
    and a lost executor costs a re-read, not a re-computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets) of a string column; a null value is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind, count=len(col) + 1, offset=col.offset * np.dtype(kind).itemsize)
    offs = offs.astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one unsigned word (an unaligned view, no copy)."""
    return np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))


def word_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    padded = np.r_[x, np.zeros(8, np.uint8)]
    eight = np.ndarray(shape=(len(x) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * BASE
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        n = np.minimum(left[live], 8)
        part = eight[at[live]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n.astype(np.uint64)))
        h[live] = mix(h[live] ^ part)
        left[live] -= 8
        at[live] += 8
        live = live[left[live] > 0]
    return h


def ranked(df: DataFrame, group: str, order: list[str], out: str = "idx") -> DataFrame:
    """Adds the 0-based place of each row among those of its ``group`` (null is a group), in ``order``.

    Rows are range-partitioned by (group, order, a unique number) and sorted there, so a group of
    any size is spread over tasks; what a partition holds of its first and last group is all that
    reaches the driver (one row per partition), and each task adds its first group's offset."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    tagged = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    placed = cut(tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    runs = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("n"))
    held = runs.groupBy("_part").agg(F.sum("n").alias("n"), F.min(F.struct(group)).alias("first"),
                                     F.max(F.struct(group, "n")).alias("last")).orderBy("_part").collect()
    offsets, open_group, carried = {}, None, 0
    for r in held:
        first, last = r["first"][0], r["last"][0]
        offsets[r["_part"]] = carried if open_group == (first,) else 0
        carried = offsets[r["_part"]] + r["n"] if first == last else r["last"]["n"]
        open_group = (last,)
    at_group, at_part = placed.columns.index(group), placed.columns.index("_part")
    kept = [k for k, c in enumerate(placed.columns) if c not in ("_row", "_part")]
    names = [placed.columns[k] for k in kept] + [out]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nxt = None, None               # the group of the row before, the next place in it
        for batch in batches:
            if batch.num_rows == 0:
                continue
            col = batch.column(at_group)
            a, b = col.slice(0, len(col) - 1), col.slice(1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            differs |= (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
            starts = np.r_[0, np.flatnonzero(differs) + 1]
            if nxt is None:
                nxt = offsets[batch.column(at_part)[0].as_py()]
            elif (col[0].as_py(),) != last:
                nxt = 0
            base = np.zeros(len(starts), np.int64)
            base[0] = nxt
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(col)]))
            place = np.arange(len(col)) - starts[run] + base[run]
            last, nxt = (col[-1].as_py(),), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(place, pa.int64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (placed.schema[k] for k in kept))
    return placed.mapInArrow(numbered, f"{schema}, {out} long")
