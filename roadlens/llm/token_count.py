"""Token counts by a map-side two-tier lookup (operator 3).

Tier 1 is a compact broadcast table of the most frequent pre-tokens (their hashes and numbers
of ids, at most ``keep`` entries); tier 2 is a bounded hash table in each Python worker, filled
by encoding the misses.  Texts never leave their task and no pre-token of the counted texts is
shuffled.  The broadcast table only saves work: the counts are the library's with any
table, an empty one included.

The table is learnt on a bounded sample of ``sample_rows`` documents, drawn by a hash of
the document id over the whole table.

Edge cases: a null or empty text has 0 tokens and 0 bytes; one very long text is split at
white space block by block; null ids, repeated ids and repeated rows give one row each;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import row_chunks, small_batches, utf8, word_hashes
from roadlens.llm.tokens import Encoder, pre_tokens

CHUNK = 2 << 20
LONGEST_FREQUENT = 64


def frequent_pieces(docs: DataFrame, id_col: str, text_col: str, sample_rows: int, keep: int) -> list[str]:
    """The most frequent pieces of a bounded sample of documents, at most ``keep``."""
    rows = docs.count()
    if not rows or not keep:
        return []
    share = min(1.0, sample_rows / rows)
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-zß-öø-ÿ]+|[0-9]|[^ \\t\\n\\ra-zß-öø-ÿ0-9]+"), 0)
    piece = F.explode(words).alias("piece")
    top = (docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
           .select(piece).where(F.length("piece").between(1, LONGEST_FREQUENT))
           .groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(keep))
    return [r.piece for r in top.select("piece").collect()]


def frequent_table(pieces: list[str], tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of ids) of each piece: what is broadcast."""
    encoder = Encoder(tokenizer_path)
    pieces = [p for p in pieces if not pre_tokens(*utf8(pa.array([p])))[4].size]
    data, offsets = utf8(pa.array(pieces, pa.string()))
    hashes = np.maximum(word_hashes(data, offsets[:-1], offsets[1:]), np.uint64(1))
    return hashes, np.array([len(i) for i in encoder.encoded(pieces, True)], np.int64)


def count_tokens(docs: DataFrame, tokenizer_path: str, over: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", sample_rows: int = 20_000, keep: int = 32_768) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    pieces = frequent_pieces(docs, id_col, text_col, sample_rows, keep)
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(pieces, tokenizer_path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, table.value)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            out = [encoder.counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                   for lo, hi in row_chunks(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))],
                names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
                       .cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")))
