"""Operators 11 to 13 against brute force and by hand (DuckDB: test_rules.test_equals_duckdb)."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import chat_format, chat_repair, merkle, sha_states
from roadlens.llm.common import ranked
from roadlens.llm.queries import QUERIES
from tests.conftest import SF0001

from .conftest import edge_rows, frame

WS = " \t\n\x0b\x0c\r"
CHAT = "conv_id long, turn long, role string, text string, key string, idx int, block int, cell int, part int, g int"
EXTRA = ("k", 1, 2, 3, 4, 5)


def chat(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], CHAT).repartition(3)


def random_chat(seed: int, conversations: int = 60, long: int = 120) -> list[tuple]:
    r = random.Random(seed)
    texts = ["hi.", "no", "", "  \n", "ok!", None, "a b.\n", "</turn> <turn user> <\\/turn>"]
    out = []
    for c in range(conversations):
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 13]) if c else long):
            text = r.choice([*texts, f"x{r.random()}.", f"y{r.random()}? ", f"z{r.random()}"])
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "s<>\\g"])
            if r.random() > 0.1:
                out.append((c if c != 7 else None, t if r.random() > 0.03 else None, role, text))
    return out


def in_order(spark, rows, empty):
    """Rows of each conversation in the operators' order."""
    h = {x.text: x.h for x in chat(spark, rows).select("text", F.xxhash64(F.coalesce("text", F.lit(empty))).alias("h")).distinct().collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, empty if r is None else r, empty if x is None else x, h[x]))
    for v in by.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[3]))
    return {c: [r[:3] for r in v] for c, v in by.items()}


def brute_repair(rows) -> tuple:
    """Every state's least (cost, audit, lines), row by row."""
    seen, faults = set(), []
    for _, r, x in rows:
        faults.append("blank" if not x.strip(WS) else "dup" if (r, x) in seen else "open" if x.rstrip(WS)[-1] not in ".!?" else "")
        seen.add((r, x))
    follows, name = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def with_inserts(now):
        now = dict(now)
        for _ in range(3):
            for q, (cost, audit, lines) in list(now.items()):
                to = "a" if q == "u" else "u"
                new = (cost + 3, audit + "I", (*lines, name[to] + ":"))
                now[to] = min(now.get(to, new), new)
        return now

    now = {"": (0, "", ())}
    for (_, r, x), fault in zip(rows, faults, strict=True):
        after: dict = {}
        def put(q, new, after=after):
            after[q] = min(after.get(q, new), new)
        for q, (cost, audit, lines) in with_inserts(now).items():
            put(q, (cost + 4, audit + "D", lines))
            if fault in ("blank", "dup"):
                continue
            more, to = 3 * (fault == "open"), "a" if q == "u" else "u"
            if r[:1] and r[:1] in follows[q]:
                put(r[:1], (cost + more, audit + "K", (*lines, f"{r}:{x}")))
            put(to, (cost + 3 + more, audit + "R", (*lines, f"{name[to]}:{x}")))
        now = after
    end = with_inserts(now)
    cost, audit, lines = min(end[q] for q in ("", "a") if q in end)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("dup"), faults.count("open"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("size", [1, 4, 512])
def test_repair_equals_brute_force(spark, size):
    rows = random_chat(size)
    df = chat(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.report(df, df, size=size).collect()}
    assert got == {c: brute_repair(v) for c, v in in_order(spark, rows, " ").items()}


def test_repair_edges(spark):
    assert chat_repair.report(chat(spark, []), chat(spark, [])).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 3, "assistant", "Yes!"), (2, None, None, None), (3, 0, "system", "S."),
            (4, 5, "user", "x" * 300_000 + "."), (4, 6, "assistant", "Ok.")]
    df = chat(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.report(df, df.unionByName(chat(spark, [(9, 1, "user", "gone")]))).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1][:7] == (2, 0, 1, 0, 1, 4, "DKK") or got[1][:7] == (2, 0, 1, 0, 1, 4, "KDK")
    assert got[2] == (0, 1, 0, 0, 0, 4, "D", empty) and got[3] == (0, 0, 0, 0, 0, 4, "D", empty)
    assert got[4][5:7] == (0, "KK") and got[9] == (0, 0, 0, 0, 0, 0, "", empty)
    fixed = [(r.role, r.text, r.edit) for r in chat_repair.repair(df.where("conv_id = 1")).orderBy("block", "at").collect()]
    assert fixed == [("user", "Hi.", "K"), ("assistant", "Yes!", "K")]


def test_least_audit_among_equals():
    """u u: delete either or insert between; deleting first is least where costs tie."""
    codes = np.array([2, 2, 3])                     # user, user, assistant without faults
    cost, exits, many, letter, place, state = chat_repair.least_paths(
        codes, np.array([3]), chat_repair.END_COST[None], np.array([0]), np.array([0]))
    assert (cost[0], exits[0], "".join(chat_repair.LETTERS[k] for k in letter)) == (3, 3, "KIKK")
    assert place.tolist() == [0, 1, 1, 2] and state.tolist() == [2, 3, 2, 3]


# ------------------------------------------------------------------ 12

def test_format_round_trip(spark):
    rows = random_chat(5, long=90)
    windows = chat_format.format_windows(chat(spark, rows), budget=64, history_turns=3, history_tokens=20)
    want = in_order(spark, rows, "")
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    assert set(got) == set(want)
    for c, v in want.items():
        learnt = "".join(x for _, r, x in v if r == "assistant")
        assert got[c].n_turns == len(v)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in v).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    cost = lambda x: len(re.findall("[A-Za-z]+|[0-9]|[^A-Za-z0-9\x00-\x20]", x)) + 4
    by = defaultdict(list)
    for w in chat_format.read_back(windows).collect():
        by[w.conv_id].append(w)
        assert w.n_turns == len(w.turns) and w.tokens == sum(cost(t.text) for t in w.turns)
        assert w.tokens <= 64 or max(cost(t.text) for t in w.turns) > 32
    assert any(w.n_context for w in by[0])
    for c, ws in by.items():
        seen: list = []
        for w in sorted(ws, key=lambda w: (w.cell, w.part)):
            turns = [(t.role, t.text) for t in w.turns]
            context = turns[:w.n_context]
            if seen and want[c][0][1] == "system":
                assert context[0] == ("system", want[c][0][2])
                context = context[1:]
            assert context == seen[len(seen) - len(context):] and len(context) <= 3
            assert w.learnt == [x for r, x in turns[w.n_context:] if r == "assistant"]
            seen += turns[w.n_context:]


def test_format_edges(spark):
    assert chat_format.digests(chat_format.format_windows(chat(spark, []))).count() == 0
    rows = [(1, 0, "system", "s " * 3000), (1, 1, "user", "u " * 3000), (1, 2, "assistant", "<turn x></turn>\n"), (1, 3, "assistant", None),
            (2, None, None, None), (None, 4, "assistant", "x" * 200_000), (3, 0, "user", "a"), (3, 0, "user", "a")]
    windows = chat_format.format_windows(chat(spark, rows))
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 4, 2: 1, None: 1, 3: 2}
    assert got[1].loss_chars == len("<turn x></turn>\n") and got[None].loss_chars == 200_000 and got[2].loss_chars == 0
    assert {w.text.count("<turn ") - w.n_turns for w in windows.collect()} == {0}


@pytest.mark.parametrize("text", ["", "<", "<\\", "</turn>", "<turn", "<\\turn", "<\\\\/turn x", "a<<turn b", "\\s\\l\\g", "\\### Assistant: </turn> ok"])
def test_escapes_are_reversible(spark, text):
    row = spark.range(1).select(F.lit(text).alias("t")).select(
        chat_format.escaped_text(F.col("t")).alias("a"), chat_format.unescaped_text(chat_format.escaped_text(F.col("t"))).alias("b"),
        chat_format.escaped_role(F.col("t")).alias("c"), chat_format.unescaped_role(chat_format.escaped_role(F.col("t"))).alias("d")).first()
    assert row.b == text and row.d == text and "<turn" not in row.a and "</turn" not in row.a and not set("<>") & set(row.c)


def test_format_has_no_python(spark):
    plan = QUERIES["op12_chat_formatting"](spark, SF0001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|Arrow", plan)


# ------------------------------------------------------------------ 13

def sha(*x: str) -> str:
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows, changed) -> list[tuple]:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(field, (r[0], r[1], r[2], r[3], t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: levels([leaf(r, r[4]) for r in by[g]]) for g in groups}
    top = levels([trees[g][-1][0] for g in groups])
    out = []
    for gi, g in enumerate(groups):
        for i, r in enumerate(by[g]):
            now, siblings = leaf(r, changed(r)), []
            for tree, k in ((trees[g], i), (top, gi)):
                for level in tree[:-1]:
                    run = level[k - k % 3:k - k % 3 + 3]
                    siblings += run[:k % 3] + run[k % 3 + 1:]
                    now, k = sha(*run[:k % 3], now, *run[k % 3 + 1:]), k // 3
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], sha(*siblings), now, now == top[-1][0]))
    return sorted(map(repr, out))


def manifest_of(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(repr(tuple(r)) for r in merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], replaced={"text": text}).collect())


def tampered(r):
    return r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]


def test_manifest_equals_brute_force(spark):
    """Groups of 1, 2, 3, 4, 729, 730 and 2,200 rows: one chunk, full chunks, two passes."""
    rows, i = [], 0
    for g, n in ((None, 5), ("", 1), ("b", 2), ("c", 3), ("d", 4), ("é", 729), ("f", 730), ("hot", 2200)):
        for k in range(n):
            rows.append((i if i != 3 else None, g, "en" if k % 3 else None, k, f"line {i}\nline" if k % 5 else None))
            i += 1
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g int, node string")
    assert manifest_of(docs.repartition(7)) == brute_manifest(rows, tampered)


def test_manifest_of_many_groups(spark):
    rows = [(k, f"s{k:05d}", None, 1, "a\nb") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_of(docs) == brute_manifest(rows, tampered)


def test_manifest_edges(spark, edge):
    assert merkle.manifest(frame(spark, []), ["doc_id", "text"]).count() == 0
    rows = [(i, "s", lang, len(t or ""), t) for i, t, lang in edge_rows()]
    assert manifest_of(edge) == brute_manifest(rows, tampered)


def test_states_resume():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (300, 32), np.uint8)
    state = np.repeat(sha_states.START[None], 100, 0)
    for k in range(3):
        kept = sha_states.packed(state)
        state = sha_states.absorb(sha_states.unpacked(kept), sha_states.hex_block(digests[100 * k:100 * k + 100]))
    got = sha_states.closed(state, np.full(100, 3))
    for i in range(100):
        assert got[i].tobytes().hex() == sha(*(digests[100 * k + i].tobytes().hex() for k in range(3)))


def test_ranked_places(spark):
    rows = [(g, k) for g, n in ((None, 40), ("a", 1), ("b", 500), ("c", 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(6)
    assert sorted(map(repr, ((r.g, r.k, r.idx) for r in ranked(df, "g", ["k"]).collect()))) == sorted(repr((g, k, k)) for g, k in rows)
    assert ranked(df.limit(0), "g", ["k"]).count() == 0
