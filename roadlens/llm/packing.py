"""Best-fit packing into fixed-length sequences by a configuration linear program (operator 2).

1. Each text is encoded once, in its task; its ids (text ids, then the end id) are cut into
   pieces of at most ``capacity``.  The pieces, without their ids, are written once.
2. The length histogram (at most ``capacity`` entries) goes to the driver, where the
   configuration linear program gives fillings and how often each is used (``config_lp``).
3. The k-th piece of a length takes the k-th slot of that length.  Positions within a length
   come from counts per (length, salt): a length gets as many salts as its share of the
   pieces asks for, so a length that a third of all documents share is split.
4. Slots are runs (filling, length), at most a few for each filling; the run of a piece is
   found by binary search in a broadcast table whose size does not depend on the input.

Edge cases: a null or empty text is the end id alone (one piece of length 1); a text longer
than the capacity is cut, its last piece may be shorter; equal documents are packed each on
their own; a null id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import cut, row_chunks, small_batches, utf8
from roadlens.llm.config_lp import pack_histogram
from roadlens.llm.tokens import Encoder

CHUNK = 2 << 20


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str,
               text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32: the pieces of each document."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for lo, hi in row_chunks(offsets, CHUNK):
                texts = encoder.ids(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for i, ids in enumerate(texts, lo):
                    ids = memoryview(b"".join((ids, end)))
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(encoded, f"id {kind}, piece int, start long, length long, ids_crc32 long"))


def slot_runs(packed: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Runs of slots by (length, first slot): key, length, per sequence, first sequence, offset in it."""
    runs, sequence, filled = [], 0, {}
    for filling, n in packed:
        offset = 0
        for length, a in sorted(filling.items(), reverse=True):
            first = filled.get(length, 0)
            runs.append(((length << 44) | first, a, sequence, offset))
            filled[length] = first + a * n
            offset += length * a
        sequence += n
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(cols[:, k]) for k in range(4))


def numbered(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``: the position of a piece among those of its length, from 0."""
    spark = pieces.sparkSession
    total = sum(histogram.values())
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = spark.createDataFrame([(k, -(-n * parts // total)) for k, n in histogram.items()],
                                  "length long, salts long")   # at most ``capacity`` rows
    salted = (pieces.join(F.broadcast(salts), "length")
              .withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).drop("salts"))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("id", "piece")
    return (salted.withColumn("k", F.row_number().over(order).cast("long") - 1)
            .join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k")))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    pieces = cut(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not histogram:
        return docs.sparkSession.createDataFrame([], schema.replace("id ", f"{id_col} ", 1))
    runs = docs.sparkSession.sparkContext.broadcast(slot_runs(pack_histogram(histogram, capacity)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, per, first, offset = runs.value
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            wanted = (length << 44) | batch.column(5).to_numpy(zero_copy_only=False)
            j = np.searchsorted(key, wanted, side="right") - 1
            slot = wanted - key[j]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[j] + slot // per[j]), pa.array(offset[j] + slot % per[j] * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = numbered(pieces, histogram).select("id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(placed, schema).withColumnRenamed("id", id_col)
