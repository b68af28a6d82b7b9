"""Suffix-array dedup of repeated byte strings (operator 10).

Every byte that a ``LENGTH``-byte (50) string covers is removed if that string also starts in
a document with a smaller id.  Suffixes are taken at content-chosen places only: of each 50
bytes, the place whose 12 following bytes hash lowest.  Equal strings choose the same place,
so comparing the suffixes there (with what lies before them) finds every repeat.

1. Sampled splitters (the leading 8 bytes of suffixes of a bounded sample) range-partition the
   suffixes; each task sends one compressed block per range.  Equal strings of a block are
   merged first: only the smallest document keeps one, so a passage that a third of all rows
   hold arrives once per block.
2. Each range is sorted locally, key word by key word (multikey): the suffix's two leading
   words, its whole neighbourhood, the document.  Neighbourhoods are the runs of 50-byte
   strings that chose the same place, so equal runs are repeats as a whole.  Where the same
   suffix has different neighbourhoods, their 50-byte strings are compared one by one.
3. A leading word that fills whole ranges is split over several buckets by document; these
   merge their equal runs and hand the remainder on to one bucket: comparison across
   boundaries.
4. Spans go back to their documents, are merged, and the remaining bytes are hashed.

All strings are judged on the input.  Equal 50-byte strings are found by 64-bit hashes of
their content within one range.

Edge cases: a null text is empty; texts under 50 bytes lose nothing; a text longer than a
block is cut into blocks that overlap by 49 bytes, so no string is missed; rows with equal
ids never remove from each other; an empty table gives an empty result; other columns are
ignored.  Ids are integers and must not be null (such rows lose nothing).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import mix, row_chunks, small_batches, utf8, words_at

LENGTH, GRAM = 50, 12                # GRAM: 8 to 16
WINDOW = LENGTH - GRAM + 1           # places that compete in one string
WIDEST = LENGTH + WINDOW - 1         # longest neighbourhood
CHUNK = 1 << 19                      # bytes of text that are searched at a time
HELD = 16 << 20                      # bytes of neighbourhoods that are sent together
RANGE_BYTES = 3 << 20                # text bytes for each range of suffixes
SAMPLE_ROWS = 4_000                  # documents whose suffixes give the splitters,
STRIDE = 16                          # one of so many
DIRECT = 512                         # ranges that a task deals to at once; more are dealt in two rounds
RUN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("n", "<u2"), ("at", "<u2")])
_REST = np.uint64((1 << 8 * (GRAM - 8)) - 1)      # of a gram's second word (first bytes are the low ones)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hash_strings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of the LENGTH bytes from each start, eight at a time."""
    eight = words_at(data)
    h = np.full(len(starts), LENGTH, np.uint64)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        h = (h ^ eight[starts + k]) * _M1
        h ^= h >> np.uint64(29)
    return mix(h)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen place, first string start, number of strings) of each run of strings that choose one place."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    eight = words_at(np.r_[data, np.zeros(16 - GRAM, np.uint8)])
    places = len(data) - GRAM + 1
    h = (eight[:places] * _M1) ^ ((eight[8:8 + places] & _REST) * _M2)
    h ^= h >> np.uint64(32)
    h *= _M1
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(places, dtype=np.uint64)     # leftmost of equals
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[WINDOW - span:WINDOW - span + n])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.diff(np.r_[first, n])


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, first byte, bytes): each text, or overlapping blocks of a longer one."""
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        if hi - lo < LENGTH:
            continue
        for at in range(lo, hi - LENGTH + 1, CHUNK):
            yield i, at - lo, data[at:min(at + CHUNK + LENGTH - 1, hi)]


def found_runs(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(RUN records, their neighbourhoods as rows of WIDEST bytes, zero-filled) of several texts."""
    records, around = [], []
    for lo, hi in row_chunks(offsets, CHUNK):
        part = []
        for i, first, piece in pieces(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]):
            at, start, n = runs(piece)
            padded = np.r_[piece, np.zeros(WIDEST, np.uint8)]
            rows = np.ndarray((len(piece), WIDEST), np.uint8, padded, strides=(1, 1))[start]
            rows[np.arange(WIDEST) >= (n + LENGTH - 1)[:, None]] = 0
            r = np.empty(len(at), RUN)
            r["doc"], r["start"], r["n"], r["at"] = ids[lo + i], first + start, n, at - start
            part.append(r)
            around.append(rows)
        records += part
    if not records:
        return np.empty(0, RUN), np.empty((0, WIDEST), np.uint8)
    return np.concatenate(records), np.concatenate(around)


def gram_words(records: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two leading 8-byte words of each suffix, in byte order."""
    base = np.arange(len(records)) * WIDEST + records["at"]
    eight = words_at(np.ascontiguousarray(around).reshape(-1))
    return eight[base].byteswap(), (eight[base + 8] & _REST).byteswap()


def run_hashes(records: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A hash of each whole neighbourhood: its first and last string cover it."""
    flat, base = np.ascontiguousarray(around).reshape(-1), np.arange(len(records)) * WIDEST
    ends = base + records["n"].astype(np.int64) - 1
    return mix(hash_strings(flat, base) * _M2 ^ hash_strings(flat, ends) ^ records["n"].astype(np.uint64) * _M1)


def merged(records: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by suffix and neighbourhood; (order, is first of its suffix, first of its neighbourhood,
    smallest document of that) - the last three in sorted order."""
    w0, w1 = gram_words(records, around)
    h = run_hashes(records, around)
    order = np.lexsort((h, w1, w0))
    w0, w1, h, doc = w0[order], w1[order], h[order], records["doc"][order]
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool), doc
    new_suffix = np.r_[True, (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])]
    new_run = new_suffix | np.r_[True, h[1:] != h[:-1]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new_run))[np.cumsum(new_run) - 1]
    return order, new_suffix, new_run, least


def spans_of(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end), neighbours of one document joined."""
    r = records[np.lexsort((records["start"], records["doc"]))]
    end = r["start"] + r["n"].astype(np.int64) + LENGTH - 1
    if not len(r):
        return r["doc"], r["start"], end
    fresh = np.r_[True, (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] > end[:-1])]
    first = np.flatnonzero(fresh)
    return r["doc"][first], r["start"][first], np.maximum.reduceat(end, first)


def string_spans(records: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the single strings that a smaller document also has; the records are
    the runs of the smallest document of each neighbourhood, for suffixes with several of them."""
    n = records["n"].astype(np.int64)
    which = np.repeat(np.arange(len(records)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    h = hash_strings(np.ascontiguousarray(around).reshape(-1), which * WIDEST + step)
    hit = np.zeros(0, np.int64)
    if len(h):
        order = np.argsort(h)
        h, doc = h[order], records["doc"][which[order]]
        new = np.r_[True, h[1:] != h[:-1]]
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = order[doc > least]
    out = np.empty(len(hit), RUN)
    out["doc"], out["start"], out["n"], out["at"] = records["doc"][which[hit]], records["start"][which[hit]] + step[hit], 1, 0
    return spans_of(out)


def packed(records: np.ndarray, around: np.ndarray) -> bytes:
    """Records and neighbourhoods (without their zero filling), compressed.

    Rows go by document and start, as differences and byte plane by byte plane: few bits each."""
    order = np.lexsort((records["start"], records["doc"]))
    records, around = records[order], around[order]
    body = around[np.arange(WIDEST) < (records["n"].astype(np.int64) + LENGTH - 1)[:, None]]
    fields = [np.diff(records[f].astype("<i8"), prepend=0).view(np.uint8).reshape(-1, 8).T for f in ("doc", "start")]
    fields += [records[f].astype(np.uint8) for f in ("n", "at")]            # both under 256
    return zstandard.compress(b"".join([np.int64(len(records)).tobytes(), *(f.tobytes() for f in fields), body.tobytes()]), 6)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
    records = np.empty(n, RUN)
    for f, width in (("doc", 8), ("start", 8), ("n", 1), ("at", 1)):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        records[f] = np.cumsum(np.ascontiguousarray(planes.T).view("<i8").reshape(-1)) if width == 8 else planes[0]
        at += n * width
    around = np.zeros((n, WIDEST), np.uint8)
    around[np.arange(WIDEST) < (records["n"].astype(np.int64) + LENGTH - 1)[:, None]] = np.frombuffer(raw, np.uint8, offset=at)
    return records, around


SENT = "bucket int, split int, blob binary, doc long, start long, stop long"


def span_batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(doc, pa.int64()),
         pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["bucket", "split", "blob", "doc", "start", "stop"])


def blob_batch(bucket: list[int], split: list[int], blob: list[bytes]) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(split, pa.int32()), pa.array(blob, pa.binary()),
         *(pa.nulls(n, pa.int64()) for _ in range(3))], names=["bucket", "split", "blob", "doc", "start", "stop"])


def reduced(records: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs whose strings a smaller document has, the other runs, their neighbourhoods)."""
    order, _, _, least = merged(records, around)
    repeat = records["doc"][order] > least
    kept = order[~repeat]
    return records[order[repeat]], records[kept], around[kept]


def resolved(records: np.ndarray, around: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All spans to remove among the runs of one range."""
    order, new_suffix, new_run, least = merged(records, around)
    repeat = records["doc"][order] > least
    suffix = np.cumsum(new_suffix) - 1
    several = np.bincount(suffix[new_run])[suffix] > 1
    rest = order[several & ~repeat]
    return [spans_of(records[order[repeat]]), string_spans(records[rest], around[rest])]


def splitters(docs: DataFrame, rows: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower bounds of the ranges from the second on, number of ranges that share each bound)."""
    share = int(min(1.0, SAMPLE_ROWS / max(rows, 1)) * 1_000_000) + 1

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            out = [np.zeros(0, np.uint64)]
            for i, first, piece in pieces(data, offsets):
                out.append(words_at(piece)[runs(piece)[0][(11 * i + first) % STRIDE::STRIDE]].byteswap())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["w"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("text")
    w = np.sort(sample.mapInArrow(leading, "w long").toPandas()["w"].to_numpy(np.int64).view(np.uint64))
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(w[(np.arange(1, ranges) * len(w)) // ranges], return_counts=True)


def route(records: np.ndarray, around: np.ndarray, bounds: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block for each range, after equal runs are merged; what is merged leaves as spans."""
    repeat, records, around = reduced(records, around)
    if len(repeat):
        yield span_batch(*spans_of(repeat))
    w0, _ = gram_words(records, around)
    bucket = np.searchsorted(bounds, w0, side="right")
    hot = np.zeros(len(w0), np.int64)      # a leading word that fills several ranges: dealt by document
    at = np.maximum(bucket - 1, 0)
    if len(bounds):
        same = (bucket > 0) & (bounds[at] == w0) & (shares[at] > 1)
        hot[same] = 1 + records["doc"][same] % shares[at[same]]
    key = bucket * (1 << 20) + hot
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True]) if len(key) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = order[lo:hi]
        yield blob_batch([int(bucket[rows[0]])], [int(hot[rows[0]])], [packed(records[rows], around[rows])])


def flush(held: list, bounds: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks (repeated runs, other runs, their neighbourhoods) that a task holds, dealt to the ranges."""
    if held:
        repeat, records = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        around = np.concatenate([h[2] for h in held])
        held.clear()
        if len(repeat):
            yield span_batch(*spans_of(repeat))
        yield from route(records, around, bounds, shares)


def sender(bounds: np.ndarray, shares: np.ndarray) -> Callable:
    """Task function: texts in, one block of runs for each range out, and the spans found on the way."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for lo, hi in row_chunks(offsets, CHUNK):
                got = found_runs(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], ids[lo:hi])
                if len(got[0]):
                    held.append(reduced(*got))
                    size += len(got[0]) * WIDEST
                if size > HELD:
                    yield from flush(held, bounds, shares)
                    held, size = [], 0
        yield from flush(held, bounds, shares)
    return send


def redealer(bounds: np.ndarray, shares: np.ndarray) -> Callable:
    """Task function: blocks of a coarse range in, larger blocks of its ranges out."""
    def redeal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                records, around = unpacked(blob)
                held.append((np.empty(0, RUN), records, around))
                size += len(records) * WIDEST
                if size > HELD:
                    yield from flush(held, bounds, shares)
                    held, size = [], 0
        yield from flush(held, bounds, shares)
    return redeal


def receiver(last: bool) -> Callable:
    """Task function over blobs sorted by bucket and split: spans out, and (not ``last``) the
    remaining runs of split buckets, for the comparison across them."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for key, split, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (key, split) != now:
                    yield from done(now, blobs)
                    now, blobs = (key, split), []
                blobs.append(blob)
        yield from done(now, blobs)

    def done(now, blobs) -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        rows = sum(int(np.frombuffer(zstandard.ZstdDecompressor().stream_reader(b).read(8), "<i8")[0]) for b in blobs)
        records, around, at = np.empty(rows, RUN), np.empty((rows, WIDEST), np.uint8), 0
        while blobs:
            r, a = unpacked(blobs.pop())
            records[at:at + len(r)], around[at:at + len(r)] = r, a
            at += len(r)
        if now[1] and not last:
            repeat, records, around = reduced(records, around)
            if len(repeat):
                yield span_batch(*spans_of(repeat))
            yield blob_batch([now[0]], [0], [packed(records, around)])
            return
        for spans in resolved(records, around):
            if len(spans[0]):
                yield span_batch(*spans)
    return take


OUT = "id long, n_bytes long, n_removed long, n_spans long, sha256 string{kept}"


def cleaner(keep_text: bool) -> Callable:
    """Task function: compressed texts with their spans in; counts, digest (and the kept text) out."""
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            spans = batch.column(2)
            for i, (doc, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                raw = zstandard.decompress(blob) if blob else b""
                cuts = []
                for s in sorted((s["start"], s["stop"]) for s in spans[i].as_py() or ()):
                    if cuts and s[0] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], s[1])
                    else:
                        cuts.append(list(s))
                at, kept = 0, []
                for lo, hi in cuts:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]]) if cuts else raw
                row = (doc, len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(),
                       left.decode("utf-8", "ignore") if keep_text else None)
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(),) * 2)]
            names = ["id", "n_bytes", "n_removed", "n_spans", "sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays[:5 + keep_text], names=names[:5 + keep_text])
    return clean


def packed_texts(texts: pa.Array) -> pa.Array:
    """Each text compressed (null stays null); a few at a time become Python objects."""
    pack, blobs = zstandard.ZstdCompressor(level=3).compress, []
    for lo, hi in row_chunks(utf8(texts)[1], CHUNK):
        blobs += [None if t is None else pack(t.encode("utf-8")) for t in texts.slice(lo, hi - lo).to_pylist()]
    return pa.array(blobs, pa.binary())


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), packed_texts(batch.column(1))], names=["id", "blob"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, start, stop: byte spans to remove (they may touch or overlap)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, -(-size // RANGE_BYTES))
    bounds, shares = splitters(rows, n, ranges)
    sent = rows.mapInArrow(sender(bounds, shares), SENT)

    def dealt(table: DataFrame, last: bool) -> DataFrame:
        """Blobs to the task of their range, one range each; spans pass through with them."""
        split = F.lit(0) if last else 17 * F.col("split")
        place = F.coalesce(F.col("bucket") + split, F.pmod(F.xxhash64("doc", "start"), F.lit(ranges)).cast("int"))
        return (table.withColumn("place", place).repartitionById(ranges, "place").sortWithinPartitions("bucket", "split")
                .drop("place").mapInArrow(passing(receiver(last)), SENT))

    if ranges > DIRECT:
        # blocks would be tiny: first to coarse ranges, where they are merged and dealt to the ranges
        coarse = bounds[::max(1, round(len(bounds) ** 0.5))]
        place = F.coalesce("bucket", F.pmod(F.xxhash64("doc", "start"), F.lit(len(coarse) + 1)).cast("int"))
        sent = (rows.mapInArrow(sender(coarse, np.ones(len(coarse), np.int64)), SENT).withColumn("place", place)
                .repartitionById(len(coarse) + 1, "place").drop("place").mapInArrow(passing(redealer(bounds, shares)), SENT))
    first = dealt(sent, False)
    second = dealt(first, True) if (shares > 1).any() else first
    return second.select("doc", "start", "stop")


def passing(task: Callable) -> Callable:
    """The task over the blobs of its rows; rows that are spans already pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def blobs() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = batch.filter(batch.column(2).is_null())
                if spans.num_rows:
                    ready.append(spans)
                if spans.num_rows < batch.num_rows:
                    yield batch.filter(batch.column(2).is_valid())
                else:
                    yield batch.slice(0, 0)
        for out in task(blobs()):
            while ready:
                yield ready.pop()
            yield out
        while ready:
            yield ready.pop()
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, sha256 of what is kept (and the kept text) for each document."""
    spans = (repeated_spans(docs, id_col, text_col).groupBy(F.col("doc").alias("id"))
             .agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .mapInArrow(compressed, "id long, blob binary"))
    out = OUT.format(kept=", kept_text string" if keep_text else "")
    return (texts.join(spans, "id", "left").select("id", "blob", "spans").mapInArrow(cleaner(keep_text), out)
            .withColumnRenamed("id", id_col))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages removed from the texts; rows without any are left as they are.

    A character that is cut through loses its remaining bytes too.  Texts travel compressed."""
    spans = (repeated_spans(docs, id_col, text_col).groupBy(F.col("doc").alias("span_id"))
             .agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    whole = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("own"), F.col(text_col).alias("text"))
    own = whole.schema["own"]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), packed_texts(batch.column(1))], names=["own", "blob"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts, spans = [], batch.column(2)
            for k, blob in enumerate(batch.column(1).to_pylist()):
                raw, at, kept = b"" if blob is None else zstandard.decompress(blob), 0, []
                for lo, hi in sorted((s["start"], s["stop"]) for s in spans[k].as_py() or ()):
                    kept.append(raw[at:max(lo, at)])
                    at = max(hi, at)
                texts.append(None if blob is None else b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["own", "text"])

    sent = whole.mapInArrow(small, T.StructType([own, T.StructField("blob", T.BinaryType())]))
    joined = sent.withColumn("span_id", F.col("own")[id_col].cast("long")).join(spans, "span_id", "left")
    cleaned = joined.select("own", "blob", "spans").mapInArrow(clean, T.StructType([own, T.StructField("text", T.StringType())]))
    return cleaned.select(*[F.col("own")[c].alias(c) if c != text_col else F.col("text").alias(c) for c in docs.columns])
