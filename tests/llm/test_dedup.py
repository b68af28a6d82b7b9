"""Operators 9 and 10 against exact answers, with large groups and split ranges."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from roadlens.llm import neardup, suffix_dedup
from roadlens.llm.components import connected
from roadlens.llm.queries import QUERIES, table
from tests.conftest import SF001

from .conftest import edge_rows, frame, words

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def exact_groups(rows: list[tuple]) -> dict:
    sets, parent = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where: dict = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def near(base: list[str], changes: int, r: random.Random) -> str:
    w = list(base)
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def groups(seed: int) -> list[tuple]:
    r, rows = random.Random(seed), []
    bases = [words(seed * 100 + k, 150, 5000).split() for k in range(4)]
    for k in range(330):
        if k % 3 == 0:
            rows.append((k, near(bases[0], r.randrange(0, 12), r), None))
        elif k % 3 == 1:
            rows.append((k, near(bases[1 + k % 3], r.randrange(0, 7), r), None))
        else:
            rows.append((k, words(seed * 1000 + k, r.randrange(0, 60), 5000), None))
    return rows + [(1000 + k, rows[0][1].upper(), None) for k in range(150)]


def found(df) -> dict:
    rows = df.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("limit, weight", [(neardup.REGION, neardup.WEIGHT), (20, neardup.WEIGHT), (neardup.REGION, 3000)])
def test_groups_equal_exact_ones(spark, limit, weight):
    """Also with regions so small that the large groups are split by depth."""
    rows = groups(1)
    assert found(neardup.near_duplicates(frame(spark, rows).repartition(4), limit=limit, weight=weight)) == exact_groups(rows)


def loose_group(seed: int) -> list[tuple]:
    """Variants of one text, pairwise just under 0.75, joined by one that is just above it to all of them; and
    a tight group around one of the variants."""
    r = random.Random(seed)
    base = words(seed, 1000, 10**6).split()

    def variant(of: list[str], changes: int) -> list[str]:
        w = list(of)
        for at in r.sample(range(0, 1000, 6), changes):
            w[at] = f"new{r.randrange(10**9)}"
        return w
    rows = [(k, variant(base, 19)) for k in range(60)]
    rows += [(100 + k, variant(rows[0][1], 1)) for k in range(40)] + [(1000, variant(base, 9))]
    return [(k, " ".join(w), None) for k, w in rows]


@pytest.mark.parametrize("limit, weight", [(6, neardup.WEIGHT), (neardup.REGION, 6000)])
def test_a_loose_group_in_cut_regions_equals_the_exact_one(spark, limit, weight):
    rows = loose_group(11)
    want = exact_groups(rows)
    assert {c for _, c in want.values()} == {0} and len({c for _, c in exact_groups(rows[:-1]).values()}) > 50
    assert found(neardup.near_duplicates(frame(spark, rows).repartition(4), limit=limit, weight=weight)) == want


def test_groups_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text, None) for r in table(spark, SF001, "documents").collect()]
    assert found(QUERIES["op9_minhash_near_dedup"](spark, SF001)) == exact_groups(rows)


def test_near_dedup_edge_rows(spark, edge):
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows())
    by_id = {r.doc_id: r for r in got}
    want = exact_groups([r for r in edge_rows() if r[0] is not None])
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id.items() if i is not None} == want
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[7].component_id == 6 and by_id[8].component_id == 6 and by_id[17].component_id == 16
    assert by_id[10].component_id == 9 and by_id[1].kept and by_id[2].kept and by_id[3].kept
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)} | {2000 + k: 2000 for k in range(1, 50)}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(143, 1143, dtype=np.uint64)      # similarity 0.75
    both = neardup.signatures(np.concatenate([neardup.mix(a), neardup.mix(b)]), np.array([0, 1000]))
    assert abs((both[0] == both[1]).mean() - 0.75) < 0.2


def brute_cut(rows: list[tuple]) -> dict:
    first: dict = {}
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t, _ in ordered:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    out = {}
    for i, t, _ in ordered:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum()), hashlib.sha256(left).hexdigest())
    return out


def cut(df) -> dict:
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha256) for r in df.collect()}


def passages(seed: int) -> list[tuple]:
    r, rows = random.Random(seed), []
    shared = [words(seed * 10 + k, n, 60) for k, n in enumerate((9, 12, 15, 40, 80))] + ["-" * 70, "ab" * 40, "é" * 40]
    for k in range(240):
        parts = [words(seed * 1000 + k, r.randrange(0, 50), 60)]
        for _ in range(r.randrange(0, 4)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            parts += [s if r.random() < 0.4 else s[a:a + r.randrange(45, 90)], words(r.randrange(10**6), r.randrange(0, 8), 60)]
        rows.append((k * 7 - 50, (" " if k % 2 else "").join(parts), None))
    return rows + [(5000 + k, rows[3][1], None) for k in range(30)] + [(9000, None, None), (9001, "short", None)]


@pytest.mark.parametrize("seed, chunk, held, ranges, direct", [
    (1, 2 << 20, 32 << 20, 8 << 20, 512), (2, 300, 2000, 1000, 512), (3, 1000, 10**9, 200, 1000), (4, 1000, 3000, 1000, 5)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, chunk, held, ranges, direct):
    """Small blocks and ranges make long texts overlap, hot leading words fill several ranges, and
    many ranges are dealt in two rounds."""
    monkeypatch.setattr(suffix_dedup, "DIRECT", direct)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", ranges)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rows = passages(seed)
    assert cut(suffix_dedup.remove_repeats(frame(spark, rows).repartition(5))) == brute_cut(rows)


def test_a_hot_leading_word_is_split_and_compared_across(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2000)
    passage = words(4, 30, 50)
    rows = [(k, f"{words(k, 6, 10**6)} {passage[:80 + k % 40]} {words(k + 500, 6, 10**6)}", None) for k in range(300)]
    docs = frame(spark, rows).repartition(20)
    assert (suffix_dedup.splitters(docs.selectExpr("doc_id as id", "text"), 300, 60)[1] > 1).any()
    assert cut(suffix_dedup.remove_repeats(docs)) == brute_cut(rows)


def test_workers_take_changed_sizes():
    """Runs of overlapping blocks of one text are those of the whole text, cut at block ends."""
    data = np.frombuffer(words(8, 3000, 50).encode(), np.uint8)
    at, start, n = suffix_dedup.runs(data)
    assert n.sum() == len(data) - 49 and (start <= at).all() and (at + suffix_dedup.GRAM <= start + 50).all()
    covered = np.concatenate([np.arange(a, a + k) for a, k in zip(start, n)])
    assert covered.tolist() == list(range(len(data) - 49))


def test_packed_records_round_trip():
    data = np.frombuffer(words(9, 2000, 80).encode(), np.uint8)
    r, a = suffix_dedup.found_runs(data, np.array([0, 3000, 3010, len(data)]), np.array([5, -9, 2**40]))
    r2, a2 = suffix_dedup.unpacked(suffix_dedup.packed(r, a))
    order = np.lexsort((r["start"], r["doc"]))
    assert (r2 == r[order]).all() and (a2 == a[order]).all()


def test_suffix_dedup_edge_rows(spark, edge):
    rows = [r for r in edge_rows() if r[0] is not None]
    got = suffix_dedup.remove_repeats(edge).collect()
    assert len(got) == len(edge_rows())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha256) for r in got if r.doc_id is not None} == brute_cut(rows)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_cut_texts_keep_their_rows(spark, edge):
    got = suffix_dedup.cut_repeats(edge)
    assert got.columns == edge.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[7].text == "" and rows[6].text == edge_rows()[5][1]
    assert rows[10].source == "s" and len(rows[10].text) < 60 and rows[10].kept == "k"


@pytest.mark.parametrize("gram", [8, 12, 16])
def test_places_depend_on_the_gram_only(gram, monkeypatch):
    """Equal 50-byte strings choose the same place in any text around them."""
    monkeypatch.setattr(suffix_dedup, "GRAM", gram)
    monkeypatch.setattr(suffix_dedup, "WINDOW", 50 - gram + 1)
    monkeypatch.setattr(suffix_dedup, "_REST", np.uint64((1 << 8 * (gram - 8)) - 1))
    shared = words(3, 40, 30).encode()

    def place(before: bytes, after: bytes) -> dict:
        at, start, n = suffix_dedup.runs(np.frombuffer(before + shared + after, np.uint8))
        return {s + k - len(before): a - len(before) for a, s, m in zip(at, start, n) for k in range(m)}
    one, two = place(b"", b""), place(b"something else 17 ", words(5, 9).encode())
    assert all(two[s] == one[s] for s in range(len(shared) - 49))
