"""Near-duplicate groups by an LSH forest over MinHash signatures (operator 9).

Documents whose sets of word 5-grams have a Jaccard similarity of at least 75 % are linked;
links make groups.

1. Each text becomes its shingle set, in its task; the set gives a signature of ``COLUMNS``
   MinHash values.  Texts with equal sets are one node from here on (smallest id).
2. Forest: each tree orders the nodes by its own sequence of signature columns, and nodes that
   share the first columns of a tree are a region.  24 trees of depth 3 miss a pair of
   similarity 0.75 with probability 2e-6.  Depth adapts to the region: the nodes of a region
   that is too large go on to deeper trees, and to so many more of them that a pair is no more
   likely to be missed there.
3. Within a region (a bounded number of nodes and shingles) the sketches of neighbours in the
   order are compared; pairs whose estimate is within four standard errors of the threshold
   are candidates.  What is too large at the last depth agrees on nearly all columns; it is cut
   by a hash of the id, drawn anew in each region, and each part also gets the region's smallest
   node.  That only joins most of its nodes cheaply; see 5.
4. Nodes with a candidate get their full sets, and each region confirms its candidates on them.
   Pairs that confirmed links of the region already join need no test of their own, so a
   region reports fewer links than it has nodes, never all its pairs.
5. Cut regions that share nodes are one cluster.  Its nodes are dealt into blocks, and every pair
   of blocks is one task that compares the nodes not yet in one component, so no pair of a cut
   region is left out.  Large components have blocks of their own, which are not compared with
   each other: a tight group costs what its loose rest costs times its size.
6. Links are contracted to components in Spark.

Only sketches of nodes with a neighbour are moved, and full sets only of candidates.

Edge cases: null or empty texts and texts without words have an empty set and are linked with
nothing; fewer than five words are one shingle; repeated rows (equal id and text) get equal
rows each; ids are otherwise unique; a null id stands alone and is kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import cut, mix, row_chunks, small_batches, utf8, word_hashes
from roadlens.llm.components import connected
from roadlens.llm.decontam import gram_hashes, words

SHINGLE = 5
COLUMNS = 96
LEVELS = [(3, 24), (6, 160), (9, 400)]     # (columns, trees) of the forest; further levels for nodes of large regions
TREES = LEVELS[0][1]
REGION = 2048            # nodes of a region that are compared in one task
WEIGHT = 8 << 20         # and their shingles (48 MB of sets)
MARGIN = 4.0             # standard errors of the estimate below the threshold that still go on
CHUNK, ROWS = 1 << 20, 4096
SET_BYTES = 6
MAX_BROADCAST = 1_000_000     # candidate ids that are broadcast to the texts (16 MB); more are joined by shuffle

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, COLUMNS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, COLUMNS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 52-bit shingle) sorted and distinct, for up to ROWS texts."""
    x, starts, ends, row = words(data, offsets, _WORD)
    h = word_hashes(x, starts, ends)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(h) >= SHINGLE:
        inside = np.flatnonzero(row[:len(h) - SHINGLE + 1] == row[SHINGLE - 1:])
        rows.append(row[inside])
        grams.append(gram_hashes(h, SHINGLE)[inside])
    for size in range(1, SHINGLE):
        own = np.flatnonzero(n_words == size)
        if len(own):
            rows.append(own)
            grams.append(gram_hashes(h, size)[first[own]])
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(52)) | (np.concatenate(grams) >> np.uint64(12))
    key = np.unique(key)
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)


def text_chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in row_chunks(offsets, CHUNK):
        for at in range(lo, hi, ROWS):
            yield at, min(at + ROWS, hi)


def signatures(shingles: np.ndarray, start: np.ndarray) -> np.ndarray:
    """MinHash values of each set: one row for each start."""
    x = mix(shingles)
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), COLUMNS), np.uint32)
    for j in range(COLUMNS):
        out[:, j] = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], start)
    return out


def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text in; id, n, k1, k2 (the set's key), sketch, trees (region keys) out."""
    columns = tree_columns(0)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        rows = len(offsets) - 1
        n, k1, k2 = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        sketch, trees = np.zeros((rows, COLUMNS), np.uint8), np.zeros((rows, TREES), np.int64)
        for lo, hi in text_chunks(offsets):
            row, s = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            if not len(row):
                continue
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            at = lo + row[start]
            n[at] = np.diff(np.r_[start, len(row)])
            k1[at] = np.add.reduceat(mix(s + np.uint64(1)), start).view(np.int64)
            k2[at] = np.add.reduceat(mix(s * np.uint64(3) + np.uint64(7)), start).view(np.int64)
            signature = signatures(s, start)
            sketch[at] = (signature & np.uint32(255)).astype(np.uint8)
            for t in range(TREES):
                key = np.full(len(at), t + 1, np.uint64)
                for c in columns[t]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, c].astype(np.uint64))
                trees[at, t] = key.view(np.int64)
        blobs = pa.array([r.tobytes() for r in sketch], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * TREES), pa.array(trees.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(k1), pa.array(k2), blobs, lists],
                                         names=["id", "n", "k1", "k2", "sketch", "trees"])


def tree_columns(level: int) -> np.ndarray:
    """Signature columns of each tree of a level: disjoint at the first level, drawn anew at each further one."""
    depth, trees = LEVELS[level]
    if level == 0:
        return np.arange(trees * depth).reshape(trees, depth)
    rng = np.random.default_rng(level)
    return np.stack([rng.permutation(COLUMNS)[:depth] for _ in range(trees)])


def deeper_rows(nodes: DataFrame, level: int) -> DataFrame:
    """(region, id, n, tree): the regions of nodes in the trees of a further level."""
    depth, trees = LEVELS[level]
    places = ", ".join(str(c + 1) for c in tree_columns(level).reshape(-1))
    key = F.expr(f"""xxhash64({level}, tree, transform(sequence(0, {depth - 1}),
        k -> substring(sketch, array({places})[tree * {depth} + k], 1)))""")
    return (nodes.select("id", "n", "sketch", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
            .select(key.alias("region"), "id", "n", "tree"))


def regions(nodes: DataFrame, limit: int, weight: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(region, id) with at least 2 and at most ``limit`` nodes and ``weight`` shingles in each region,
    (id, hot): the trees of the first level whose region of the node is too large, and (id, hub): the
    nodes of the cut regions with each region's smallest one, if a region had to be cut."""
    def sized(table: DataFrame) -> DataFrame:
        whole = table.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1")
        big = (F.col("size") > limit) | (F.col("size") > 2) & (F.col("weight") > weight)
        return cut(table.join(whole.select("region", big.alias("big")), "region"))

    now = sized(nodes.select("id", "n", F.posexplode("trees").alias("tree", "region")))
    done = now.where("not big").select("region", "id")
    hot = now.where("big").groupBy("id").agg(F.collect_set("tree").alias("hot"))
    for level in range(1, len(LEVELS)):
        if now.where("big").isEmpty():
            return done, hot, None
        large = now.where("big").select("id").distinct()
        now = sized(deeper_rows(nodes.join(large, "id", "left_semi"), level))
        done = done.union(now.where("not big").select("region", "id"))
    big = now.where("big")
    if big.isEmpty():
        return done, hot, None
    parts = big.groupBy("region").agg(
        (2 * F.greatest(F.ceil(F.count(F.lit(1)) / (limit - 1)), F.ceil(F.sum("n") / weight))).alias("parts"),
        F.min("id").alias("hub"))
    salted = big.join(parts, "region").select(
        F.xxhash64("region", F.pmod(F.xxhash64("id", "region"), F.col("parts"))).alias("region"), "id", "hub")
    return (done.union(salted.select("region", "id").union(salted.select("region", "hub")).distinct()), hot,
            salted.select("id", "hub").distinct())


def needed(threshold: float) -> int:
    """Agreeing columns from which a pair is a candidate."""
    return int(np.floor(COLUMNS * (threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / COLUMNS))))


def by_region(task: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """Calls ``task`` with whole regions (several at a time) of rows that are sorted by region."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column(0).to_numpy()
            last_starts = int(np.flatnonzero(region == region[-1])[0])     # the last region may go on
            if last_starts or rest and rest[-1].column(0)[0].as_py() != region[0]:
                yield from task(pa.Table.from_batches([*rest, batch.slice(0, last_starts)]))
                rest = []
            rest.append(batch.slice(last_starts))
        if rest:
            yield from task(pa.Table.from_batches(rest))
    return run


def own_pairs(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of the candidate pairs among rows (region, id, sketch, marks).

    A pair counts in the first tree that holds both (``marks``: one number for each tree, equal
    where both are in one region that was not split), or else in each region that does."""
    table = table.combine_chunks()
    region, n = table.column(0).to_numpy(), table.num_rows
    sketch = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(n, COLUMNS)
    marks = table.column(3).combine_chunks().flatten().to_numpy().reshape(n, TREES)
    own_mark = (region.view(np.uint64) >> np.uint64(33)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
    size = np.diff(np.r_[first, n])
    left_in = np.repeat(first + size, size) - np.arange(n)        # rows of the region from here on
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, int(size.max())):
        i = np.flatnonzero(left_in > lag)
        for lo in range(0, len(i), 65_536):
            a = i[lo:lo + 65_536]
            a = a[np.count_nonzero(sketch[a] == sketch[a + lag], axis=1) >= least]
            equal = marks[a] == marks[a + lag]
            a = a[~equal.any(1) | (marks[a, equal.argmax(1)] == own_mark[a])]
            left.append(a)
            right.append(a + lag)
    return np.concatenate(left), np.concatenate(right)


def cross_pairs(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of the candidate pairs of different components among rows (region, id, sketch,
    side, component) in order of region and side: one side against the other, or all pairs of a
    region that has one side."""
    table = table.combine_chunks()
    region, side, group = (table.column(c).to_numpy() for c in ("region", "side", "component"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COLUMNS)
    first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]]).tolist()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(first, [*first[1:], len(region)]):
        other = lo + int(np.count_nonzero(side[lo:hi] == 0))
        for i in range(lo, other):
            at = other if other < hi else i + 1
            j = at + np.flatnonzero(group[at:hi] != group[i])
            j = j[np.count_nonzero(sketch[j] == sketch[i], axis=1) >= least]
            left.append(np.full(len(j), i))
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def comparer(least: int, pairs: Callable = own_pairs, kept: tuple[str, ...] = ("region", "id")) -> Callable:
    """Task function over the rows of ``pairs``: the columns ``kept`` of the nodes with a candidate."""
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = np.unique(np.concatenate(pairs(table, least)))
        yield from table.select(list(kept)).take(pa.array(rows)).combine_chunks().to_batches()
    return by_region(compare)


def set_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text in; id, the set as sorted 48-bit numbers out."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        out = [b""] * (len(offsets) - 1)
        for lo, hi in text_chunks(offsets):
            row, s = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            if not len(row):
                continue
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            packed = (s >> np.uint64(4)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
            for at, a, b in zip((lo + row[start]).tolist(), start.tolist(), [*start[1:].tolist(), len(row)]):
                out[at] = packed[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "set"])


def numbers(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, SET_BYTES)
    return wide.reshape(-1).view("<u8")


def similar(mine: np.ndarray, theirs: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of several sets have the wanted similarity with one."""
    sizes, flat = np.array([len(t) for t in theirs]), np.concatenate(theirs)
    place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(mine) + sizes - both)


def confirmer(least: int, percent: int, pairs: Callable = own_pairs) -> Callable:
    """Task function over the rows of ``pairs`` and their sets: confirmed links that join what no
    earlier link of the region (nor their components, if known) did."""
    def confirm(table: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = pairs(table, least)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        ids, sets = table.column("id").to_numpy(), table.column("set")
        group, known, found = np.arange(table.num_rows), {}, []
        if "component" in table.column_names:
            group = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]

        def members(row: int) -> np.ndarray:
            if row not in known:
                known[row] = numbers(sets[row].as_py())
            return known[row]

        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
            own, rest = int(i[lo]), j[lo:hi]
            while len(rest := rest[group[rest] != group[own]]):
                part, rest = rest[:256], rest[256:]
                near = similar(members(own), [members(int(r)) for r in part], percent)
                for r in part[near].tolist():
                    if group[r] != group[own]:
                        group[group == group[r]] = group[own]
                        found.append((ids[own], ids[r]))
            known.pop(own, None)
        a, b = (np.array(c, np.int64) for c in (zip(*found) if found else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return by_region(confirm)


def full_sets(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(id, set) of the nodes with a candidate."""
    wanted = cut(near.select("id").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    return rows.join(wanted, "id", "left_semi").mapInArrow(set_blobs, "id long, set binary").dropDuplicates(["id"])


def components_of(ids: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``ids`` with the smallest node of each id's component as column ``name``."""
    roots = connected(edges).select(F.col("node").alias("id"), F.col("root").alias(name))
    return ids.join(roots, "id", "left").withColumn(name, F.coalesce(name, "id"))


def block_pairs(loose: DataFrame, nodes: DataFrame, found: DataFrame, limit: int, weight: int) -> DataFrame:
    """(region, id, side, component) of the nodes of cut regions: a region is a pair of blocks of one cluster
    (or one block) that holds nodes of different components, with about half of ``limit`` and ``weight``."""
    def parts(size: str, n: str):
        return F.greatest(F.ceil(4 * F.col(size) / limit), F.ceil(4 * F.col(n) / weight))

    ids = nodes.select("id", "n").join(loose.select("id").distinct(), "id", "left_semi")
    ids = components_of(ids, loose.select(F.col("id").alias("a"), F.col("hub").alias("b")), "cluster")
    ids = cut(components_of(ids, found, "component"))
    sizes = ids.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    several = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    alone = parts("size", "weight") > 1
    owners = cut(sizes.join(several, "cluster", "left_semi").select(
        "cluster", "component", "size", "weight", alone.alias("alone"),
        F.when(alone, F.col("component")).otherwise(F.col("cluster")).alias("owner")))
    dealt = (owners.groupBy("cluster", "alone", "owner").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"))
             .select("cluster", "alone", "owner", parts("size", "weight").alias("parts")))
    key = F.xxhash64("cluster", "alone", "owner", "part")
    blocks = cut(dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                 .select("cluster", "alone", "owner", key.alias("block")))
    one, two = blocks.alias("x"), blocks.alias("y")
    pairs = cut(one.join(two, F.expr("""x.cluster = y.cluster and x.block <= y.block
                                        and not (x.alone and y.alone and x.owner = y.owner)"""))
                .select(F.xxhash64("x.block", "y.block").alias("region"), F.col("x.block").alias("left"),
                        F.col("y.block").alias("right")))
    sides = (pairs.select("region", F.lit(0).alias("side"), F.col("left").alias("block"))
             .union(pairs.where("left <> right").select("region", F.lit(1), "right")))
    placed = (ids.join(owners.select("cluster", "component", "alone", "owner"), ["cluster", "component"])
              .join(dealt, ["cluster", "alone", "owner"])
              .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
              .select("id", "component", key.alias("block")))
    return placed.join(sides, "block").select("region", "id", "side", "component")


def loose_links(rows: DataFrame, nodes: DataFrame, loose: DataFrame, found: DataFrame, percent: int, limit: int,
                weight: int) -> DataFrame:
    """Confirmed pairs of nodes of cut regions that ``found`` leaves in different components."""
    parts, least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), needed(percent / 100)
    sketches = nodes.select("id", "sketch")
    near = cut(block_pairs(loose, nodes, found, limit, weight).join(sketches, "id")
               .select("region", "id", "sketch", "side", "component")
               .repartition(parts, "region").sortWithinPartitions("region", "side", "id")
               .mapInArrow(comparer(least, cross_pairs, ("region", "id", "side", "component")),
                           "region long, id long, side int, component long"))
    return (near.join(sketches, "id").join(full_sets(rows, near), "id")
            .select("region", "id", "sketch", "side", "component", "set")
            .repartition(parts, "region").sortWithinPartitions("region", "side", "id")
            .mapInArrow(confirmer(least, percent, cross_pairs), "a long, b long").distinct())


def links(rows: DataFrame, nodes: DataFrame, percent: int, limit: int, weight: int) -> DataFrame:
    """Confirmed pairs of nodes, enough to join each group."""
    members, hot, loose = regions(nodes, limit, weight)
    marks = F.expr("""transform(trees, (x, t) -> cast(shiftrightunsigned(
        if(array_contains(coalesce(hot, array()), t), xxhash64(id, t), x), 33) as int))""")
    marked = nodes.join(hot, "id", "left").select("id", "sketch", marks.alias("marks"))
    parts, least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), needed(percent / 100)
    near = cut(members.join(marked, "id").select("region", "id", "sketch", "marks")
               .repartition(parts, "region").sortWithinPartitions("region", "id")
               .mapInArrow(comparer(least), "region long, id long"))
    found = cut(near.join(marked.join(full_sets(rows, near), "id"), "id").select("region", "id", "sketch", "marks", "set")
                .repartition(parts, "region").sortWithinPartitions("region", "id")
                .mapInArrow(confirmer(least, percent), "a long, b long").distinct())
    return found if loose is None else cut(found.union(loose_links(rows, nodes, cut(loose), found, percent, limit, weight)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    limit: int = REGION, weight: int = WEIGHT) -> DataFrame:
    """id, n_shingles, component_id (smallest id of the group), kept (whether it is that)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles = cut(rows.mapInArrow(profiled, "id long, n long, k1 long, k2 long, sketch binary, trees array<long>"))
    copies = cut(profiles.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("node")))
    nodes = (profiles.join(copies.select(F.col("node").alias("id")), "id", "left_semi").where("n > 0")
             .select("id", "n", "sketch", "trees").dropDuplicates(["id"]))
    found = links(rows.where("id is not null"), cut(nodes), percent, limit, weight)
    groups = (copies.join(connected(found), "node", "left")
              .select("k1", "k2", F.coalesce("root", "node").alias("component")))
    own = profiles.select("id", "n", "k1", "k2").join(groups, ["k1", "k2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
