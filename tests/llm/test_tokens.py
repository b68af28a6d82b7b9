"""Operators 2 and 3: exact ids and counts, and the packing program."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from roadlens.llm.common import utf8
from roadlens.llm.config_lp import cover, pack_histogram
from roadlens.llm.packing import pack
from roadlens.llm.token_count import count_tokens, frequent_table
from roadlens.llm.tokens import Encoder, HashTable, blocks, load_tokenizer

from .conftest import edge_rows, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "é", "É", "ß", "×", "1", "23", "!", "!!", "'s", "'", "<|endoftext|>", "<", "|", " ", "\n", "\t", "\x0b", "\x1c",
       "\u00a0", "\u2028", "日本", "e\u0301", "İ", "ſ", "Σ", "😂", "don't", "_", "¼", "Ⅷ", "ª", "[", "\\", "^", "`", "~"]


@pytest.mark.parametrize("slots", [1 << 9, 1 << 21])
def test_ids_and_counts_equal_the_library(slots):
    """Also with a table so small that it is emptied all the time."""
    r, encoder = random.Random(1), Encoder(PATH, slots=slots)
    counter = Encoder(PATH, frequent_table(["ab", "the", "zz9", "it's", "é"], PATH), slots=slots)
    plain = ["ab", "Cd", "é", "É", "Þ", "ÿ", " ", "1", "!", "?,", ".", "\n", "[", "\\", "22", "|"]
    texts = ["".join(r.choice(v) for _ in range(r.randint(0, 40))) for v in (ODD, plain) for _ in range(1500)]
    r.shuffle(texts)
    for lo in range(0, len(texts), 300):
        part = texts[lo:lo + 300]
        columns = utf8(pa.array(part))
        want = [e.ids for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.ids(*columns)] == want
        assert counter.counts(*columns).tolist() == [len(w) for w in want]


def test_a_long_text_is_taken_in_parts(monkeypatch):
    monkeypatch.setattr("roadlens.llm.tokens.LONG", 64)
    encoder, r = Encoder(PATH), random.Random(4)
    for text in ["".join(r.choice(ODD + [" "] * 12) for _ in range(900)), "x" * 5000, " " * 500, "word " * 700]:
        columns = utf8(pa.array([text]))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(*columns)[0], "<u4").tolist() == want and encoder.counts(*columns).tolist() == [len(want)]


def test_hash_table_with_crowded_slots():
    table, h = HashTable(64), np.arange(1, 31, dtype=np.uint64)
    h[10:] |= np.uint64(63 << 58)              # most share the last slot and wrap around
    table.add(h, np.arange(30), np.arange(30) * 2)
    at = table.find(h)
    assert (table.start[at] == np.arange(30)).all() and (table.length[at] == 2 * np.arange(30)).all()
    assert (table.find(np.arange(100, 110, dtype=np.uint64)) == -1).all()


def test_blocks_join_to_the_text(monkeypatch):
    monkeypatch.setattr("roadlens.llm.tokens.BLOCK", 10)
    for text in ("", "short", "words of a longer text\nwith lines", "x" * 50, " " * 30):
        assert "".join(blocks(text)) == text


@pytest.mark.parametrize("keep", [0, 1000])
def test_counts_on_edge_rows(spark, edge, keep):
    tokenizer = load_tokenizer(PATH)
    want = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
                  for i, t, _ in edge_rows())
    got = count_tokens(edge, PATH, keep=keep)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert count_tokens(frame(spark, []), PATH).count() == 0


def test_packing_on_edge_rows(spark, edge):
    tokenizer, want = load_tokenizer(PATH), []
    for i, t, _ in edge_rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want.append((str(i), k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    rows = pack(edge, PATH).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(w[3] for w in want) // 4096)
    assert pack(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("low, high, n", [(1, 4096, 3000), (1100, 2040, 4000), (1000, 3000, 6000), (4096, 4097, 50), (1, 2, 9000)])
def test_configuration_program(low, high, n):
    lengths = np.random.default_rng(3).integers(low, high, n)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    placed: dict[int, int] = {}
    packed = pack_histogram(histogram, 4096)
    for filling, times in packed:
        assert sum(k * a for k, a in filling.items()) <= 4096
        for k, a in filling.items():
            placed[k] = placed.get(k, 0) + a * times
    assert placed == histogram
    assert sum(t for _, t in packed) <= best_fit(histogram, 4096)


def best_fit(histogram: dict[int, int], capacity: int) -> int:
    free, bins = np.zeros(capacity + 1, int), 0
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = np.flatnonzero(free[size:])
            if len(fits):
                free[size + fits[0]] -= 1
                free[fits[0]] += 1
            else:
                bins += 1
                free[capacity - size] += 1
    return bins


@pytest.mark.parametrize("mean", [80, 300, 700])
def test_program_is_near_its_bound(mean):
    """Text-like lengths (many short, a long tail) at a hundred times the counts: the fractional answer is
    within 1 % of the dual bound, and nearly all pieces are in its rounded fillings."""
    drawn = np.minimum(np.random.default_rng(3).lognormal(np.log(mean), 1.1, 5000).astype(int) + 1, 4095)
    lengths, counts = np.unique(drawn, return_counts=True)
    got = cover(lengths, 100 * counts, 4096)
    assert got.bound <= got.value(lengths, 4096) <= 1.01 * got.bound
    assert sum(n for _, n in pack_histogram({int(k): int(100 * c) for k, c in zip(lengths, counts, strict=True)}, 4096)) <= 1.002 * got.bound + 1
    placed = sum(a * int(x + 1e-9) for key, x in got.times.items() for _, a in key)
    assert placed > 0.9 * 100 * counts.sum()
    for key, x in got.times.items():
        assert x > 0 and sum(int(lengths[i]) * a for i, a in key) <= 4096
    covered = np.zeros(len(lengths))
    for key, x in got.times.items():
        for i, a in key:
            covered[i] += a * x
    assert np.allclose(covered + got.left, 100 * counts)


def test_dual_bound_is_proven():
    """No packing is smaller than the bound: against the best of all packings of a few pieces."""
    got = cover(np.array([30, 45, 70]), np.array([4, 3, 2]), 100)
    assert got.bound <= 4 + 1e-9 and got.bound > 3.8     # 395 tokens: four sequences of 100 at least
