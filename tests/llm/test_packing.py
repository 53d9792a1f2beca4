import random
import zlib

import numpy as np
import pytest
from helpers import table

from tidelog.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_match_the_tokenizer(docs, tokenizer):
    rows = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == sorted(want, key=repr)
    check_places(rows, 4096)


def test_words_one_by_one_are_the_whole_text(tokenizer):
    texts = ["It's 12 o'clock... isn't it?!", "A\u0301 e\u0301 \u0130I \u03a3\u03a3 K", "<|endoftext|> x<|ENDOFTEXT|>y", "a.b,c;d!!e?)f|g", "日本語テキスト ab\u00a0cd\u2003ef", "don't DON'T 's 'S", "naïve—dash“quote”", "\u0301 lone mark", "x" * 5000]
    own = packing.WordTokenizer(tokenizer.to_str())
    for text, found in zip(texts, own([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_open_bins_are_bounded():
    rng = random.Random(0)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    for most in (1, 2, 8, 1000):
        bins, offsets = packing.best_fit(lengths, 100, most)
        used = {}
        for b, o, x in zip(bins, offsets, lengths, strict=True):
            assert used.get(b, 0) == o
            used[b] = o + x
            assert used[b] <= 100


def brute_best_fit(lengths, capacity, most):
    """Open bins as a list: the fullest that fits, else a new one, for which the fullest closes if too many are open."""
    opened, is_open, out = [], [], []
    for x in lengths:
        fit = [b for b in is_open if opened[b] + x <= capacity]
        if fit:
            b = max(fit, key=lambda b: opened[b])
        else:
            if len(is_open) == most:
                is_open.remove(max(is_open, key=lambda b: opened[b]))
            b = len(opened)
            opened.append(0)
            is_open.append(b)
        opened[b] += x
        if opened[b] == capacity:
            is_open.remove(b)
        out.append(opened[b])
    return opened, out


@pytest.mark.parametrize("most", [1, 3, 8, 1000])
def test_online_best_fit_matches_brute_force(most):
    rng = random.Random(most)
    lengths = [rng.choice([rng.randint(1, 100), 100, 1]) for _ in range(800)]
    bins, offsets = packing.best_fit(lengths, 100, most)
    opened, after = brute_best_fit(lengths, 100, most)
    assert [o + x for o, x in zip(offsets, lengths, strict=True)] == after  # bins of one free space are alike
    assert len(set(bins)) == len(opened)


def test_the_bound_closes_bins():
    """With few open bins some close before they are full; more of them waste less."""
    rng = random.Random(5)
    lengths = [rng.randint(10, 60) for _ in range(2000)]
    need = {most: len(set(packing.best_fit(lengths, 100, most)[0])) for most in (1, 4, 64)}
    assert need[1] > need[4] > need[64] >= sum(lengths) / 100


def test_waste_against_the_bound(spark):
    """Whole documents, online: within 2 % of the sequences that the tokens alone need, and one a shard."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    assert check_places(rows, 4096) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_small_capacity_and_empty(spark, rows, empty):
    found = packing.pack_documents(table(spark, rows[:5], ["_shard", "length"]), packing.default_tokenizer(), capacity=50, shard_bytes=500, keep_ids=True).collect()
    check_places(found, 50)
    assert all(len(r.ids) == 4 * r.length for r in found)
    assert packing.pack_documents(empty, packing.default_tokenizer()).count() == 0


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(None, f"text number {i}", None, None, None) for i in range(300)] + [(7, "the same row", None, None, None)] * 50
    found = packing.pack_documents(table(spark, rows), packing.default_tokenizer(), capacity=64, shard_bytes=1000).collect()
    check_places(found, 64)
    assert len(found) == 350 and sum(r.doc_id == 7 for r in found) == 50
    assert len({r.sequence_id >> 32 for r in found if r.doc_id is None}) > 5
