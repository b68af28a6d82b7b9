"""Benchmark decontamination by winnowing (operator 6).

Words are ASCII letters (lower-cased), ASCII digits and non-ASCII characters in a row.  Of
each span of ``window`` words (10) the smallest hash of its ``gram``-word grams (5) is kept
as a fingerprint, for items and documents alike, so any shared span of 10 words shares a
fingerprint at the same place.  A fingerprint carries the 5 words on either side of its
gram; an item and a document that agree on the fingerprint are compared word by word to
both sides, which finds every shared 10-word window around it.  Items of fewer than 10
words have one fingerprint, of all their words.

Plan: both tables are fingerprinted in their tasks.  Documents keep only fingerprints whose
hash some item has (a broadcast bit table of the item hashes, of fixed size); those are
joined with the items' in Spark by hash and agreement, and hits are merged per document.
The broadcast table does not decide anything, it only drops most rows before the shuffle.

A document is known by its id and the 64-bit hash of its text, so rows with a null id and rows
that share an id are judged each by its own text.

Edge cases: a null or empty text has no words; a null id is an id like others; repeated items are
each counted; repeated rows are judged alike; an item without words matches nothing; empty tables
give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import BASE, cut, mix, row_chunks, small_batches, utf8, word_hashes

WINDOW, GRAM = 10, 5
SIDE = WINDOW - GRAM
CHUNK = 1 << 20
BITS = 1 << 24           # size of the broadcast bit table: 2 MB

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _WORD,
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word starts, word ends, row of each word); no word crosses rows."""
    x = _FOLD[data]
    inside = np.r_[False, in_word[x], False].astype(np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    if len(cuts) and len(starts):            # a word that runs over a row's end is two words
        at = np.searchsorted(starts, cuts, side="right") - 1
        split = np.unique(cuts[(at >= 0) & (starts[at] < cuts) & (ends[at] > cuts)])
        starts, ends = np.sort(np.r_[starts, split]), np.sort(np.r_[ends, split])
    row = np.searchsorted(offsets, starts, side="right") - 1
    return x, starts, ends, row


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(len(h) - size + 1, 0), size, np.uint64) * BASE
    for k in range(size):
        out = mix(out * BASE ^ h[k:len(h) - size + 1 + k])
    return out


def winnow(g: np.ndarray, row: np.ndarray, size: int, span: int) -> np.ndarray:
    """Positions of grams that are the (leftmost) smallest of some ``span`` grams of one row."""
    n = len(g)
    valid = row[:n] == row[size - 1:size - 1 + n]
    rank = np.where(valid, g, np.uint64(0xFFFFFFFFFFFFFFFF))
    count = n - span + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    whole = row[:count] == row[span + size - 2:span + size - 2 + count]
    starts = np.flatnonzero(whole)
    best, at = rank[starts].copy(), starts.copy()
    for k in range(1, span):
        other = rank[starts + k]
        less = other < best
        best[less], at[less] = other[less], starts[less] + k
    return np.unique(at)


def fingerprints(data: np.ndarray, offsets: np.ndarray, short: set[int], own_short: bool = False,
                 ) -> Iterator[tuple[np.ndarray, ...]]:
    """Yields (size, first word, hash, folded bytes, word starts, word ends, row, words before the row).

    ``short``: also all grams of these sizes (documents); ``own_short``: rows of under
    WINDOW words as one gram (items)."""
    x, starts, ends, row = words(data, offsets)
    h = word_hashes(x, starts, ends)
    before = np.searchsorted(row, np.arange(len(offsets) - 1))
    if len(h) >= GRAM:
        g = gram_hashes(h, GRAM)
        at = winnow(g, row, GRAM, WINDOW - GRAM + 1)
        yield GRAM, at, g[at], x, starts, ends, row, before
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    for size in (sorted(set(n_words[(n_words > 0) & (n_words < WINDOW)].tolist())) if own_short else sorted(short)):
        if len(h) < size:
            continue
        g = mix(gram_hashes(h, size) + np.uint64(size) * BASE)      # unlike any winnowed hash
        at = before[n_words == size] if own_short else np.flatnonzero(row[:len(g)] == row[size - 1:])
        yield -size, at, g[at], x, starts, ends, row, before


def word_list(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, at: int, size: int,
              ) -> tuple[list[str], list[str], list[str]]:
    """(the gram, up to SIDE words before it, nearest first, up to SIDE words after it)."""
    text = lambda i: x[starts[i]:ends[i]].tobytes().decode("utf-8", "surrogateescape")
    own = row[at]
    left = [text(i) for i in range(at - 1, max(at - SIDE, 0) - 1, -1) if row[i] == own]
    right = [text(i) for i in range(at + size, min(at + size + SIDE, len(starts))) if row[i] == own]
    return [text(i) for i in range(at, at + size)], left, right


PRINT = "id {kind}, size int, at int, hash long, gram array<string>, before array<string>, after array<string>"


def printed(table: DataFrame, id_col: str, text_col: str, short: set[int], own_short: bool, bits) -> DataFrame:
    """The fingerprints of a table's texts (of those with a hash in ``bits``, if given)."""
    kind = table.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            cols: list[list] = [[] for _ in range(7)]
            for lo, hi in row_chunks(offsets, CHUNK):
                part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                for size, at, hashes, *text, first in fingerprints(part, offs, short, own_short):
                    if known is not None:
                        bit = (hashes & np.uint64(BITS - 1)).astype(np.int64)
                        found = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        at, hashes = at[found], hashes[found]
                    row = text[3]
                    for i, v in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        r = int(row[i])
                        g, left, right = word_list(*text, i, abs(size))
                        for c, value in zip(cols, (lo + r, size, i - int(first[r]), v, g, left, right)):
                            c.append(value)
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            words_type = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                 *(pa.array(c, words_type) for c in cols[4:])],
                names=["id", "size", "at", "hash", "gram", "before", "after"])

    return (table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(make, PRINT.format(kind=kind)))


def bit_table(prints: DataFrame) -> bytes:
    """BITS bits, set at the item hashes: each task ORs its own, the driver ORs the tasks' in a tree."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            seen.update((batch.column(0).to_numpy() & (BITS - 1)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["bit"])

    rows = prints.select("hash").mapInArrow(local, "bit long").distinct().toPandas()["bit"].to_numpy(np.int64)
    bits = np.zeros(BITS >> 3, np.uint8)
    np.bitwise_or.at(bits, rows >> 3, np.uint8(1) << (rows & 7).astype(np.uint8))
    return bits.tobytes()


def document_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc (``document_key``), items, first, last: spans of document words [first, last) in windows of the items.

    Items whose fingerprints agree with all words around them are one row of the join, so a passage
    of many items meets a document once."""
    small_batches(docs.sparkSession)
    of_items = cut(printed(items, item_col, item_text, set(), True, None)
                   .groupBy("size", "hash", "gram", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
                   .agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("items")))
    short = {-r["size"] for r in of_items.where("size < 0").select("size").distinct().collect()}   # at most 9
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(of_items))
    keyed = docs.select(document_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    of_docs = printed(keyed, "doc", "text", short, False, bits)
    same = lambda a, b: F.aggregate(  # noqa: E731  number of leading places where both agree
        F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, x: F.struct((s.n + (s.on & x).cast("int")).alias("n"), (s.on & x).alias("on")), lambda s: s.n)
    joined = of_docs.join(of_items, ["hash", "size", "gram"])
    left, right = same(F.col("before"), F.col("i_before")), same(F.col("after"), F.col("i_after"))
    spans = (joined.withColumn("l", F.when(F.col("size") > 0, left).otherwise(0))
             .withColumn("r", F.when(F.col("size") > 0, right).otherwise(0))
             .where((F.col("size") < 0) | (F.col("l") + F.col("size") + F.col("r") >= WINDOW)))
    return spans.select(F.col("id").alias("doc"), "items", (F.col("at") - F.col("l")).alias("first"),
                        (F.col("at") + F.abs("size") + F.col("r")).alias("last"))


def n_words(text) -> F.Column:
    """Number of words of a text, counted without building them."""
    return F.coalesce(F.regexp_count(text, F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")), F.lit(0)).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated for each document."""
    found = (hits(docs, items, id_col, text_col, item_col, item_text).groupBy("doc")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                  F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], s.upto))).alias("n"),
                              F.greatest(s.upto, x["last"]).alias("upto")), lambda s: s.n)
    found = found.withColumn("hit", merged.cast("long"))
    base = docs.select(document_key(id_col, text_col).alias("doc"), n_words(F.col(text_col)).alias("n_words"))
    none = F.array().cast("array<string>")
    return (base.join(found, "doc", "left")
            .select(F.col("doc.id").alias(id_col), "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"), "spans", F.col("hit").isNotNull().alias("contaminated")))


def without_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    found = hits(docs, items, id_col, text_col, item_col, item_text).select("doc").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), document_key(id_col, text_col).alias("doc"))
    return rows.join(found, "doc", "left_anti").select("row.*")
