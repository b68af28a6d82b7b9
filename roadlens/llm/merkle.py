"""Merkle dataset manifest by a tree of SHA midstates (operator 13).

Each row is a leaf; leaves stand in the order of their id within their group, every ``FAN``
consecutive nodes have one parent, and the groups' roots, in the order of the groups, have a tree
of their own above them.  A digest's hex text fills exactly one SHA-256 block, so a parent's hash
state before each child slot is eight words: the tree keeps these states.  A changed leaf is
folded to a new root by resuming, at each level, the state before its slot with the replacement
and the right siblings only; left siblings are never hashed again.

1. Leaves are hashed in Spark; their places come from a range partition (``common.ranked``).
2. Each pass puts ``CHUNK`` = FAN ** LEVELS consecutive nodes of a group into one row, builds the
   levels above them and writes nodes and states; the row's root is a node of the next pass, until
   each group is one node.  Then the groups' roots go through the same passes.
3. From the top down each row gives its nodes their paths (state, slot and siblings per level),
   joined by (group, chunk).  The last step folds every leaf through its row and the row's path.

A pass shrinks its input by CHUNK; no task holds more than one row beside its batch (some 150
bytes for each leaf of a chunk), and a group of any size is spread over tasks.  The driver sees
one number per pass and one row per partition.

Edge cases: null fields hash as ``-``; a null id is the first of its group, a null group the first
group; rows with the same id stand in the order of their leaves; a group of one row has its leaf as
root; a lone node at the end of a longer level has a parent of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm import sha_states as sha
from roadlens.llm.common import cut, ranked, small_batches

FAN = 3
LEVELS = 6
CHUNK = FAN ** LEVELS


def field_text(col: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, fields)), 256))


# ------------------------------------------------------------------ one batch of chunks (numpy)

def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)]


class Level:
    """Nodes (n, 32) of all chunks of a batch, and what their parents keep."""

    def __init__(self, sizes: np.ndarray, nodes: np.ndarray):
        self.sizes, self.nodes, self.first = sizes, nodes, offsets(sizes)
        self.parents: np.ndarray | None = None       # per chunk: number of parents
        self.grows: np.ndarray | None = None         # per chunk: whether there is a level above
        self.states: np.ndarray | None = None        # per parent: states before slots 1, 2, ... as bytes

    def above(self, alone: np.ndarray) -> np.ndarray:
        """Hashes the parents, keeping a copy of the state before each slot."""
        self.grows = ~(alone & (self.sizes <= 1))
        self.parents = -(-self.sizes // FAN)
        up = offsets(self.parents)
        chunk = np.repeat(np.arange(len(self.sizes)), self.parents)
        j = np.arange(up[-1]) - up[chunk]
        at, n = self.first[chunk] + FAN * j, np.minimum(FAN, self.sizes[chunk] - FAN * j)
        state = np.repeat(sha.START[None], up[-1], 0)
        self.states = np.zeros((up[-1], FAN - 1, 32), np.uint8)
        for slot in range(FAN):
            if slot:
                self.states[:, slot - 1] = sha.packed(state)
            live = np.flatnonzero(n > slot)
            state[live] = sha.absorb(state[live], sha.hex_block(self.nodes[at[live] + slot]))
        nodes = sha.closed(state, n)
        stays = ~self.grows[chunk]
        nodes[stays] = self.nodes[at[stays]]
        return nodes

    def steps(self, chunk: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the nodes at place ``i`` of their chunks: first sibling, slot, number in the run, state before the slot."""
        slot, run = i % FAN, i // FAN
        at = self.first[chunk] + FAN * run
        n = np.minimum(FAN, self.sizes[chunk] - FAN * run)
        parent = offsets(self.parents)[chunk] + run
        state = np.where((slot == 0)[:, None], sha.packed(sha.START)[None], self.states[parent, np.maximum(slot, 1) - 1])
        return at, slot, n, state


def grow(sizes: np.ndarray, nodes: np.ndarray, alone: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """The levels of the chunks and their roots; ``alone``: the only chunk of its group, done when one node is left."""
    levels = []
    for _ in range(LEVELS):
        levels.append(Level(sizes, nodes))
        nodes, sizes = levels[-1].above(alone), levels[-1].parents
    return levels, nodes


def resume(node: np.ndarray, state: np.ndarray, slot: np.ndarray, n: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Parents' digests: the state before the slot, the node, then its right siblings (rows, FAN - 1, 32)."""
    now = sha.absorb(sha.unpacked(state), sha.hex_block(node))
    for k in range(FAN - 1):
        live = np.flatnonzero(slot + 1 + k < n)
        now[live] = sha.absorb(now[live], sha.hex_block(right[live, k]))
    return sha.closed(now, n)


def blob(col: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, end to end."""
    _, ends, data = col.buffers()
    ends = np.frombuffer(ends, np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)


def sized(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes, ``sizes`` bytes each."""
    ends = offsets(sizes).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def rebuilt(batch: pa.RecordBatch) -> tuple[list[Level], np.ndarray]:
    """The levels of a batch of written chunks (columns sizes, nodes, states), and each leaf's chunk."""
    counts = batch.column("n").to_numpy(zero_copy_only=False)
    alone = batch.column("alone").to_numpy(zero_copy_only=False)
    n_chunks = len(counts)
    nodes, states = blob(batch.column("nodes")).reshape(-1, 32), blob(batch.column("states")).reshape(-1, FAN - 1, 32)
    shape = [counts]
    for _ in range(LEVELS):
        shape.append(-(-shape[-1] // FAN))
    node_at, state_at = offsets(sum(shape[:-1]))[:-1], offsets(sum(shape[1:]))[:-1]
    levels = []
    for k in range(LEVELS):
        def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
            return np.repeat(start, size) + np.arange(size.sum()) - np.repeat(offsets(size)[:-1], size)
        level = Level(shape[k], nodes[spread(node_at, shape[k])])
        level.parents, level.grows = shape[k + 1], ~(alone & (shape[k] <= 1))
        level.states = states[spread(state_at, shape[k + 1])]
        levels.append(level)
        node_at, state_at = node_at + shape[k], state_at + shape[k + 1]
    return levels, np.repeat(np.arange(n_chunks), counts)


# ------------------------------------------------------------------ passes

def build_pass(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """One row per chunk of (g, idx, node): g, chunk, n, alone, nodes and states (level after level), root,
    and the ``extra`` columns as lists."""
    rows = (nodes.groupBy("g", F.expr(f"idx div {CHUNK}").alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "node", *extra))).alias("rows"))
            .select("g", "chunk", F.col("rows.node").alias("leaves"), *[F.col(f"rows.{c}").alias(c) for c in extra]))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            leaves = batch.column(2)
            counts = np.diff(leaves.offsets.to_numpy()).astype(np.int64)
            # a chunk that is not full is its group's last one: the only one if it is the first, too
            alone = (batch.column(1).to_numpy(zero_copy_only=False) == 0) & (counts < CHUNK)
            levels, roots = grow(counts, blob(leaves.flatten()).reshape(-1, 32), alone)
            def by_chunk(parts: list[np.ndarray], shapes: list[np.ndarray], width: int) -> pa.Array:
                chunk = np.concatenate([np.repeat(np.arange(len(counts)), s) for s in shapes])
                data = np.concatenate([p.reshape(-1, width) for p in parts])[np.argsort(chunk, kind="stable")]
                return sized(data, sum(shapes) * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(alone),
                 by_chunk([x.nodes for x in levels], [x.sizes for x in levels], 32),
                 by_chunk([x.states for x in levels], [x.parents for x in levels], 32 * (FAN - 1)),
                 sized(roots, np.full(len(counts), 32)), *(batch.column(k) for k in range(3, batch.num_columns))],
                names=["g", "chunk", "n", "alone", "nodes", "states", "root", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return cut(rows.mapInArrow(built, f"g {kinds['g']}, chunk long, n long, alone boolean, nodes binary, states binary, "
                               "root binary" + "".join(f", {c} {kinds[c]}" for c in extra)))


def passes(nodes: DataFrame, extra: list[str]) -> list[DataFrame]:
    """Passes until every group is one chunk; the last one's roots are the groups'."""
    found = [build_pass(nodes, extra)]
    while (found[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        found.append(build_pass(found[-1].select("g", F.col("chunk").alias("idx"), F.col("root").alias("node")), []))
    return found


def with_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks with the path, subroot and root of their roots."""
    p = paths.select(F.col("g").alias("_g"), F.col("idx").alias("_i"), "path", "subroot", "top")
    return chunks.join(p, chunks["g"].eqNullSafe(p["_g"]) & (chunks["chunk"] == p["_i"])).drop("_g", "_i")


def descend(chunks: DataFrame, paths: DataFrame, ids: str | None = None) -> DataFrame:
    """(g, idx, path, subroot, top) for each node of ``chunks``; with ``ids`` (the list column of the
    groups' tree that holds the groups) g is that value, idx 0 and the node itself the subroot.

    A path is, level after level up to the root: slot, number in the run, the state before the slot,
    the siblings from left to right."""
    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            levels, chunk = rebuilt(batch)
            place = np.arange(len(chunk)) - levels[0].first[chunk]
            paths, i = [b""] * len(chunk), place
            for level in levels:
                at, slot, n, state = level.steps(chunk, i)
                grows = level.grows[chunk]
                for k in np.flatnonzero(grows):
                    run = level.nodes[at[k]:at[k] + n[k]]
                    paths[k] += (bytes([slot[k], n[k]]) + state[k].tobytes() + run[:slot[k]].tobytes() + run[slot[k] + 1:].tobytes())
                i = i // FAN
            upper = batch.column("path").to_pylist()
            path = pa.array([p + upper[c] for p, c in zip(paths, chunk, strict=True)], pa.binary())
            take = pa.array(chunk)
            if ids:
                g, idx, sub = batch.column(ids).flatten(), np.zeros(len(chunk), np.int64), sized(levels[0].nodes, np.full(len(chunk), 32))
            else:
                idx = batch.column("chunk").to_numpy(zero_copy_only=False)[chunk] * CHUNK + place
                g, sub = batch.column("g").take(take), batch.column("subroot").take(take)
            yield pa.RecordBatch.from_arrays([g, pa.array(idx), path, sub, batch.column("top").take(take)],
                                             names=["g", "idx", "path", "subroot", "top"])

    joined = with_paths(chunks, paths)
    kind = joined.schema[ids].dataType.elementType.simpleString() if ids else joined.schema["g"].dataType.simpleString()
    return joined.mapInArrow(down, f"g {kind}, idx long, path binary, subroot binary, top binary")


def split_path(path: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """slot, number in the run, state, siblings for each level."""
    out, k = [], 0
    while k < len(path):
        slot, n = path[k], path[k + 1]
        out.append((slot, n, path[k + 2:k + 34], path[k + 34:k + 34 + 32 * (n - 1)]))
        k += 34 + 32 * (n - 1)
    return out


def fold_batch(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each leaf of a batch of chunks with paths: its proof's hash, its folded root, its chunk."""
    levels, chunk = rebuilt(batch)
    upper = [split_path(p) for p in batch.column("path").to_pylist()]
    i = np.arange(len(chunk)) - levels[0].first[chunk]
    node = blob(batch.column("changed").flatten()).reshape(-1, 32)
    proofs = [hashlib.sha256() for _ in range(len(chunk))]
    for level in levels:
        at, slot, n, state = level.steps(chunk, i)
        text = memoryview(sha.hex_text(level.nodes).tobytes())
        live = np.flatnonzero(level.grows[chunk])
        for k, a, s, e in zip(live.tolist(), (64 * at[live]).tolist(), (64 * slot[live]).tolist(), (64 * n[live]).tolist(), strict=True):
            proofs[k].update(text[a:a + s])
            proofs[k].update(text[a + s + 64:a + e])
        beside = np.minimum(at[:, None] + slot[:, None] + 1 + np.arange(FAN - 1), len(level.nodes) - 1)
        folded = node.copy()
        folded[live] = resume(node[live], state[live], slot[live], n[live], level.nodes[beside[live]])
        node, i = folded, i // FAN
    rest = [b"".join(x[3] for x in steps).hex().encode() for steps in upper]
    for k, c in enumerate(chunk.tolist()):
        proofs[k].update(rest[c])
    for t in range(max(map(len, upper), default=0)):
        slot, n = np.zeros(len(upper), np.int64), np.zeros(len(upper), np.int64)
        state, right = np.zeros((len(upper), 32), np.uint8), np.zeros((len(upper), FAN - 1, 32), np.uint8)
        for c, steps in enumerate(upper):
            if t < len(steps):
                slot[c], n[c], held, siblings = steps[t]
                state[c] = np.frombuffer(held, np.uint8)
                after = np.frombuffer(siblings, np.uint8).reshape(-1, 32)[slot[c]:]
                right[c, :len(after)] = after
        live = np.flatnonzero(n[chunk])
        c = chunk[live]
        folded = node.copy()
        folded[live] = resume(node[live], state[c], slot[c], n[c], right[c])
        node = folded
    return [p.hexdigest() for p in proofs], node, chunk


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
             replaced: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    ``replaced`` gives fields other values, as a later copy of the data would have; folded_root is
    the root with that row's leaf made of them (its own leaf, where nothing differs)."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = {c: F.col(c) for c in fields}
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("g"),
                         leaf_hash(list(columns.values())).alias("node"),
                         leaf_hash(list((columns | (replaced or {})).values())).alias("changed"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean")
    built = passes(ranked(leaves, "g", ["id", "node"]), ["id", "changed"])
    groups = built[-1].select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("root").alias("node"))
    tree = passes(ranked(groups, "g", ["name"]), ["name"])
    paths = tree[-1].select("g", F.col("chunk").alias("idx"), F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"),
                            F.col("root").alias("top"))
    for chunks in reversed(tree[1:]):
        paths = cut(descend(chunks, paths))
    paths = cut(descend(tree[0], paths, "name"))
    for chunks in reversed(built[1:]):
        paths = cut(descend(chunks, paths))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text(nodes: np.ndarray) -> pa.Array:
            return sized(sha.hex_text(nodes), np.full(len(nodes), 64)).cast(pa.string())
        for batch in batches:
            if batch.num_rows == 0:
                continue
            proofs, roots, chunk = fold_batch(batch)
            own = rebuilt(batch)[0][0].nodes
            top = blob(batch.column("top")).reshape(-1, 32)[chunk]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").flatten(), text(own), text(blob(batch.column("subroot")).reshape(-1, 32)[chunk]), text(top),
                 pa.array(proofs), text(roots), pa.array((roots == top).all(1))],
                names=[id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return with_paths(built[0], paths).mapInArrow(folded, schema)
