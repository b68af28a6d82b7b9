"""Conversation structure repair: cost DP, then prefix-doubling path ranking (operator 11).

A conversation's roles are to follow  (s?(ua)+)?  by their initials.  Rows may be kept (free),
given the role user or assistant (3), deleted (4; a must for blank rows and for rows whose role and
text came before), and empty rows may be inserted (3); a truncated row that stays costs 3 more.

1. Rows get their places (``common.ranked``), faults their first kind; a place is a duplicate if
   it is not the least one of its (conversation, role, text).  Then only one byte per row goes on.
2. ``BLOCK`` rows of a conversation are one block.  A block is a 4 x 4 matrix of least costs between
   the states of the grammar, so the costs to go at each block's end come from (min, +) products;
   conversations of one block need none.
3. In each block the cost to go of every node (place, state) gives the arcs of cheapest repairs.
   These arcs are ranked by prefix doubling: rank and successor after 2^k letters of the audit give
   those after 2^(k+1).  Within a state each letter leads to one node only, so two arcs of a node
   differ in their first letter and the doubled pointers of the least arc spell the least path;
   the path is read off through them, all its places at once.
4. Blocks of one conversation chain by their entry and exit states.

No task holds more than a block and, for a conversation of many blocks, their matrices (N / BLOCK
of 16 numbers).  Repaired texts are streamed in order; a digest of them is sequential by nature.

Edge cases: null roles and texts are one space; null turns come first, rows of one turn in the order
of role and text hash; rows with null conversation form one; an empty role fits nowhere; repeated
rows are duplicates; a conversation of which nothing may stay has no rows left; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import cut, ranked, small_batches

BLOCK = 512
ROWS = 1 << 16                     # rows that are solved together
NEVER = 1 << 40
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; what comes next where a role is chosen:
CHOSEN = np.array([2, 2, 3, 2])
ROLE_OF = {2: "user", 3: "assistant"}
# a row's byte is its class (1 s, 2 u, 3 a, 0 another) + 4 x fault
KEPT = np.full((4, 4), -1)
KEPT[1, 0], KEPT[2, [0, 1, 3]], KEPT[3, 2] = 1, 2, 3
LEGAL = np.zeros((4, 4), bool)
LEGAL[1, 2] = LEGAL[2, 3] = LEGAL[3, 2] = True
END_COST = np.array([0, 6, 3, 0], np.int64)     # to end after each state: by inserting what lacks
END_EDITS = {0: [], 1: [2, 3], 2: [3], 3: []}


def row_arcs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs (n, 4 states, 4 letters) and next states of what may be done with a row; inserts aside."""
    kind, fault = code % 4, code // 4
    cost = np.full((len(code), 4, 4), NEVER, np.int64)
    to = np.zeros((len(code), 4, 4), np.int64)
    cost[:, :, 0], to[:, :, 0] = 4, np.arange(4)
    stays = (fault != BLANK) & (fault != DUPLICATE)
    more = np.where(fault == TRUNCATED, 3, 0)
    kept = KEPT[kind]
    cost[:, :, 2] = np.where(stays[:, None] & (kept >= 0), more[:, None], NEVER)
    to[:, :, 2] = np.maximum(kept, 0)
    cost[:, :, 3] = np.where(stays, 3 + more, NEVER)[:, None]
    to[:, :, 3] = CHOSEN
    return cost, to


def after_inserts(least: np.ndarray) -> np.ndarray:
    """Costs to go (n, 4) if rows may be inserted first."""
    v = least.copy()
    v[:, 2] = np.minimum(least[:, 2], 3 + least[:, 3])
    v[:, 3] = np.minimum(least[:, 3], 3 + least[:, 2])
    v[:, :2] = np.minimum(least[:, :2], 3 + v[:, 2:3])
    return v


def costs_to_go(codes: np.ndarray, first: np.ndarray, n: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(nodes, 4): least cost from each place and state of each block to the end; a block has n + 1 places."""
    places = np.r_[0, np.cumsum(n + 1)]
    v = np.full((places[-1], 4), NEVER, np.int64)
    v[places[1:] - 1] = end
    cost, to = row_arcs(np.arange(16))
    for k in range(1, int(n.max()) + 1):
        live = np.flatnonzero(n >= k)
        code = codes[first[live] + n[live] - k]
        at = places[live] + n[live] - k
        after = v[at + 1]
        each = cost[code] + np.take_along_axis(after, to[code].reshape(len(live), 16), 1).reshape(-1, 4, 4)
        v[at] = np.minimum(after_inserts(each.min(2)), NEVER)
    return v


def matrices(codes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(blocks, 4, 4): least cost from each state before a block to each state after it."""
    out = np.full((len(n), 4, 4), NEVER, np.int64)
    for q in range(4):
        end = np.full((len(n), 4), NEVER, np.int64)
        end[:, q] = 0
        v = costs_to_go(codes, first, n, end)
        out[:, :, q] = v[np.r_[0, np.cumsum(n + 1)][:-1]]
    return out


def least_paths(codes: np.ndarray, n: np.ndarray, end: np.ndarray, block_of: np.ndarray, entry: np.ndarray
                ) -> tuple[np.ndarray, ...]:
    """The least audit of each (block, entry state): cost, exit state, number of letters, then per letter
    its kind, its place (row) and the state after it.  Lanes without a repair have no letters."""
    first = np.r_[0, np.cumsum(n)][:-1]
    places = np.r_[0, np.cumsum(n + 1)]
    v = costs_to_go(codes, first, n, end)
    block = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) + block                       # the node before each row
    cost, to = row_arcs(codes)
    target = 4 * (place[:, None, None] + 1) + to
    # an insert stays at its place
    cost[:, :, 1], target[:, :, 1] = 3, 4 * place[:, None] + CHOSEN
    togo = v.reshape(-1)
    here = v[place][:, :, None]
    best = (here < NEVER) & (cost < NEVER) & (cost + togo[target] == here)
    row, state, letter = np.nonzero(best)                       # in the order of node, then letter
    node, target = 4 * place[row] + state, target[row, state, letter]
    arcs = len(node)
    head = np.full(4 * places[-1], arcs)                        # a node's least arc; none: the end
    head[node[::-1]] = np.arange(arcs)[::-1]
    after = np.r_[head[target], arcs]
    rank = np.r_[letter + 1, 0]
    many, doubled = np.r_[np.ones(arcs, np.int64), 0], [after]
    while (after != arcs).any():
        rank = np.unique(rank * (arcs + 2) + rank[after], return_inverse=True)[1]
        many = many + many[after]
        after = after[after]
        doubled.append(after)
    start = 4 * places[block_of] + entry
    lo, hi = np.searchsorted(node, start), np.searchsorted(node, start, side="right")
    first_arc = np.full(len(start), arcs)
    for k in range(4):                                          # the start's arc of least rank
        has = np.flatnonzero(lo + k < hi)
        best_yet = np.where(first_arc[has] == arcs, np.iinfo(np.int64).max, rank[first_arc[has]])
        first_arc[has] = np.where(rank[lo[has] + k] < best_yet, lo[has] + k, first_arc[has])
    letters = many[first_arc]
    lane = np.repeat(np.arange(len(start)), letters)
    t = np.arange(len(lane)) - np.repeat(np.r_[0, np.cumsum(letters)][:-1], letters)
    at = first_arc[lane]
    for k, jump in enumerate(doubled):
        at = np.where((t >> k) & 1, jump[at], at)
    exits = np.full(len(start), -1)
    ends = np.cumsum(letters)[letters > 0] - 1
    exits[letters > 0] = target[at[ends]] % 4
    return togo[start], exits, letters, letter[at], row[at] - first[block_of[lane]], target[at] % 4


# ------------------------------------------------------------------ Spark

def key_of(col: Column) -> Column:
    """A text that is never null and differs for different values."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def placed_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """key, idx (place in the conversation), turn, role, text."""
    space = F.lit(" ")
    flat = rows.select(key_of(F.col(conv)).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
                       F.coalesce(F.col(text).cast("string"), space).alias("text"))
    return ranked(flat.withColumn("_same", F.xxhash64("text")), "key", ["turn", "role", "_same"]).drop("_same")


def coded_blocks(placed: DataFrame, size: int) -> DataFrame:
    """key, block, before (class of the row before the block, -1 for none), codes (a byte per row)."""
    left = F.rtrim(F.col("text"), F.lit(SPACES))
    kind = F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(1), F.lit("u"), F.lit(2), F.lit("a"), F.lit(3)),
                                   F.substring("role", 1, 1)), F.lit(0))
    least = placed.groupBy("key", "role", F.sha2("text", 256).alias("same")).agg(F.min("idx").alias("idx")).select(
        "key", "idx", F.lit(True).alias("new"))
    plain = placed.select("key", "idx", kind.alias("kind"), (left == "").alias("blank"),
                          (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("open"))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(0))
    coded = plain.join(least, ["key", "idx"], "left").select("key", "idx", (F.col("kind") + 4 * fault).cast("int").alias("code"))
    own = F.expr(f"idx div {size}")
    # a block's last row is also shown to the next one
    seen = F.when(F.col("idx") % size == size - 1, F.array(own, own + 1)).otherwise(F.array(own))
    return (coded.select("key", F.explode(seen).alias("block"), "idx", "code").groupBy("key", "block")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "code"))).alias("s"))
            .select("key", "block", F.expr(f"if(s[0].idx < block * {size}, s[0].code % 4, -1)").alias("before"),
                    F.expr(f"transform(filter(s, x -> x.idx >= block * {size}), x -> x.code)").alias("codes"))
            .where(F.size("codes") > 0))


def flat_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.flatten().to_numpy().astype(np.int64), np.diff(col.offsets.to_numpy()).astype(np.int64)


def with_ends(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks with ``end``: the costs to go after them, by state."""
    alone = (F.col("block") == 0) & (F.size("codes") < size)
    single = blocks.where(alone).withColumn("end", F.array(*[F.lit(int(x)) for x in END_COST]).cast("array<long>"))

    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, n = flat_codes(batch.column(2))
                m = matrices(codes, np.r_[0, np.cumsum(n)][:-1], n).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 16, pa.int32()), pa.array(m))],
                    names=["key", "block", "m"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, block, end = [], [], []
            for k, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                go = END_COST
                for r in reversed(rows.as_py()):
                    key.append(k)
                    block.append(r["block"])
                    end.append(go.tolist())
                    go = np.minimum((np.array(r["m"]).reshape(4, 4) + go).min(1), NEVER)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(block, pa.int64()), pa.array(end, pa.list_(pa.int64()))],
                                             names=["key", "block", "end"])

    several = blocks.where(~alone)
    costs = several.select("key", "block", "codes").mapInArrow(costed, "key string, block long, m array<long>")
    ends = (costs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("s"))
            .mapInArrow(chained, "key string, block long, end array<long>"))
    return single.unionByName(several.join(ends, ["key", "block"]))


def block_repairs(blocks: DataFrame, size: int) -> DataFrame:
    """key, block, entry, cost (to the end), exit, letters, places (null: inserted), roles (null: kept, deleted)."""
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = flat_codes(batch.column("codes"))
            ends = np.cumsum(n)
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + ROWS, side="right")))
                yield solve(batch.slice(lo, hi - lo), codes[ends[lo] - n[lo]:ends[hi - 1]], n[lo:hi])
                lo = hi

    def solve(batch: pa.RecordBatch, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        number = batch.column("block").to_numpy(zero_copy_only=False)
        end = np.array(batch.column("end").to_pylist(), np.int64)
        lanes = np.where(number == 0, 1, 4)                     # only the first block's entry is known
        block_of = np.repeat(np.arange(len(n)), lanes)
        entry = np.arange(len(block_of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        cost, exits, many, letter, place, state = least_paths(codes, n, end, block_of, entry)
        lane = np.repeat(np.arange(len(many)), many)
        place = place + number[block_of[lane]] * size
        ends = pa.array(np.r_[0, np.cumsum(many)], pa.int32())
        role = np.where(letter % 2 == 1, np.array(["", "", "user", "assistant"])[state], "")
        lists = (pa.array(np.array(list(LETTERS))[letter]), pa.array(place, mask=letter == 1),
                 pa.array(role.tolist(), pa.string(), mask=letter % 2 == 0))
        take = pa.array(block_of)
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(take), batch.column("block").take(take), pa.array(entry), pa.array(cost), pa.array(exits, pa.int64()),
             *(pa.ListArray.from_arrays(ends, x) for x in lists)],
            names=["key", "block", "entry", "cost", "exit", "letters", "places", "roles"])

    return with_ends(blocks, size).select("key", "block", "codes", "end").mapInArrow(
        solved, "key string, block long, entry long, cost long, exit long, letters array<string>, places array<long>, roles array<string>")


def chosen_repairs(found: DataFrame) -> DataFrame:
    """Of the repairs of each block the one that starts where the block before ended."""
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, block, entry = [], [], []
            for k, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state, number = 0, -1
                for r in rows.as_py():                          # by block, then entry
                    if r["entry"] == state and r["block"] > number:
                        key.append(k)
                        block.append(number := r["block"])
                        entry.append(state)
                        state = r["exit"]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(block, pa.int64()), pa.array(entry, pa.int64())],
                                             names=["key", "block", "entry"])

    more = found.where("block > 0").select("key").distinct()
    several = found.join(more, "key", "left_semi")
    chain = (several.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "entry", "exit"))).alias("s"))
             .mapInArrow(walked, "key string, block long, entry long"))
    return found.join(more, "key", "left_anti").unionByName(several.join(chain, ["key", "block", "entry"]).select(*found.columns))


def edits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, block, at, edit, role, text: the edits in order; faults per block)."""
    small_batches(rows.sparkSession)
    placed = cut(placed_rows(rows, conv, turn, role, text))
    blocks = cut(coded_blocks(placed, size))
    found = cut(chosen_repairs(cut(block_repairs(blocks, size))))
    last = found.groupBy("key").agg(F.max(F.struct("block", "exit")).alias("z")).select("key", "z.block", "z.exit")
    added = F.element_at(F.create_map(*[F.lit(x) for q in (1, 2) for x in (q, ",".join(ROLE_OF[s] for s in END_EDITS[q]))]),
                         F.col("exit").cast("int"))
    tail = last.where("exit in (1, 2)").select("key", "block", F.posexplode(F.split(added, ",")).alias("at", "role")).select(
        "key", "block", (F.col("at") + (1 << 30)).alias("at"), F.lit("I").alias("edit"), F.lit(None).cast("long").alias("idx"), "role")
    each = found.select("key", "block", F.posexplode(F.arrays_zip("letters", "places", "roles")).alias("at", "e")).select(
        "key", "block", "at", F.col("e.letters").alias("edit"), F.col("e.places").alias("idx"), F.col("e.roles").alias("role"))
    own = placed.select("key", "idx", F.col("role").alias("_role"), "text")
    inserted = each.where("idx is null").unionByName(tail).withColumn("text", F.lit(""))
    others = each.where("idx is not null").join(own, ["key", "idx"]).withColumn("role", F.coalesce("role", "_role")).drop("_role")
    done = others.unionByName(inserted).select("key", "block", "at", "edit", "role", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = flat_codes(batch.column(2))
            block = np.repeat(np.arange(len(n)), n)
            first = np.r_[0, np.cumsum(n)][:-1]
            before = np.r_[0, codes[:-1] % 4]
            before[first] = batch.column(1).to_numpy(zero_copy_only=False)
            wrong = (before >= 0) & ~LEGAL[before, codes % 4]
            sums = [np.bincount(block[x], minlength=len(n)) for x in (codes // 4 == BLANK, codes // 4 == DUPLICATE, codes // 4 == TRUNCATED, wrong)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["key", "blank", "duplicate", "truncated", "illegal"])

    faults = blocks.select("key", "before", "codes").mapInArrow(counted, "key string, blank long, duplicate long, truncated long, illegal long")
    cost = found.where("block = 0").select("key", "cost")
    turns = placed.groupBy("key", "turn").agg(F.count(F.lit(1))).groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    sums = faults.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    return done, turns.join(sums, "key").join(cost, "key")


def digests(done: DataFrame) -> DataFrame:
    """key, audit, repaired_sha256 of the edits, streamed in order: nothing but the hash is held."""
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, digest = None, [], None
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                                              names=["key", "audit", "repaired_sha256"])
        for batch in batches:
            ready = []
            for k, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "edit", "role", "text")), strict=True):
                if k != key:
                    if digest is not None:
                        ready.append(row())
                    key, audit, digest, joint = k, [], hashlib.sha256(), b""
                audit.append(edit)
                if edit != "D":
                    digest.update(joint + f"{role}:{text}".encode())
                    joint = b"\n"
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if digest is not None:
            yield row()

    return (done.repartition("key").sortWithinPartitions("key", "block", "at")
            .mapInArrow(streamed, "key string, audit string, repaired_sha256 string"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: key, block and at (the order), role, text, edit (K, R or I)."""
    return edits(rows, conv, turn, role, text)[0].where("edit <> 'D'")


def report(rows: DataFrame, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", size: int = BLOCK) -> DataFrame:
    """One row for each distinct ``conv`` of ``conversations``: faults, cost, audit, digest of the repaired rows."""
    done, faults = edits(rows, conv, turn, role, text, size)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select(conv).distinct().withColumn("key", key_of(F.col(conv)))
    return (ids.join(faults, "key", "left").join(digests(done), "key", "left")
            .select(conv, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
