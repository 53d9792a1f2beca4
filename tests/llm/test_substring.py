import hashlib

import numpy as np
import pytest
from helpers import table

from tidelog.llm import substring


def brute(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (float("inf") if i is None else i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def same_as_brute(docs, **how):
    found = substring.remove_repeats(docs, **how)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()], key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("group", "block", "slots"), [(1 << 20, 6 << 20, 1 << 13), (64, 4000, 1 << 6)])
def test_matches_brute_force(docs, group, block, slots):
    """Small groups and few slots force longer prefixes, up to the whole window; small blocks spread copies."""
    same_as_brute(docs, group_suffixes=group, block_bytes=block, least_slots=slots)


def test_windows_of_the_same_words_in_another_order(spark):
    """Words as a Thue-Morse sequence, and its opposite, agree under any polynomial hash modulo 2**64 whose base is odd."""
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ turn] for x in thue) for turn in (0, 1))
    around = ["one two three four five six", "seven eight nine ten eleven twelve"]
    docs = table(spark, [(1, f"{around[0]} {a} {around[1]}", None, None, None), (2, f"{around[0]} {b} {around[1]}", None, None, None)])
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0}
    words = [" ".join("ab"[x ^ turn] for x in thue) for turn in (0, 1)]
    same_as_brute(table(spark, [(1, words[0], None, None, None), (2, words[1], None, None, None)]))


def test_prefixes_grow_until_a_group_fits(docs):
    """Passages that share their first words need prefixes of three words and more; each suffix has one group, and groups are small."""
    texts = [(r.text or "").encode() for r in docs.collect()] + [b"the same four words " + f"{i} {i + 1} {i + 2} ".encode() * 5 for i in range(200)]
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    prefixes = substring.prefix_groups(rows, sum(map(len, texts)), group_suffixes=150, least_slots=1 << 10)
    s = substring.Suffixes(texts)
    groups = prefixes.groups(s)
    assert len(prefixes.tables) >= 4 and groups.min() >= 0
    sizes = np.bincount(groups)
    placed = sizes[: prefixes.first_deep]
    assert placed.max() <= 300 and (placed > 0).sum() > 20
    for k in range(3):  # equal windows meet
        full = s.prefix(substring.WINDOW)
        assert len(np.unique(np.stack([full, groups.astype(np.uint64)]), axis=1).T) == len(np.unique(full))


def test_nodes_of_the_tree_know_common_prefixes():
    base = "a b c d e f g h i j k l m".split()
    texts = [base, [*base[:9], "x", *base[10:]], [*base[:5], "y", *base[6:]], ["z", *base[1:]], base]
    s = substring.Suffixes([" ".join(t).encode() for t in texts])
    order, common = substring.tree_nodes(s.path())
    place = {int(d): k for k, d in enumerate(order)}
    between = lambda i, j: min(common[min(place[i], place[j]) + 1 : max(place[i], place[j]) + 1])
    assert (between(0, 4), between(0, 1), between(0, 2), between(0, 3)) == (13, 8, 4, 0)
    assert substring.tree_repeats(s.path(), np.array([3, 1, 2, 0, 5])).tolist() == [False, False, False, False, True]


def test_rows_without_an_id_are_spread_and_ids_are_integers(spark):
    rng = __import__("random").Random(2)
    from helpers import prose

    passage = prose(rng, 30)
    rows = [(None, f"{prose(rng, 30)} {passage}" if i % 2 else prose(rng, 40), None, None, None) for i in range(100)] + [(5, passage, None, None, None)]
    docs = table(spark, rows, ["block", "_block", "grp"])
    same_as_brute(docs, block_bytes=3000)
    found = substring.remove_repeats(docs, block_bytes=3000)
    assert {(r.block, r["_block"], r.grp) for r in found.collect()} == {("own", "own", "own")}
    blocks = docs.select(substring.block_of(8, "doc_id", "text").alias("b")).distinct().count()
    assert blocks == 8
    with pytest.raises(TypeError, match="integer"):
        substring.remove_repeats(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_very_long_words(spark):
    word, other = "x" * 3000, "x" * 2999 + "y"
    rows = [(1, f"{word} " * 14, None, None, None), (2, f"{other} " * 14, None, None, None), (3, f"{word} " * 13, None, None, None)]
    same_as_brute(table(spark, rows))


def test_spans_and_text(docs):
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in substring.remove_repeats(docs).filter("n_removed > 0").collect():
        words = source[r.doc_id].encode().split()
        for s in r.spans:
            assert s.end - s.first >= 13
        left = [w for k, w in enumerate(words) if not any(s.first <= k < s.end for s in r.spans)]
        assert r.text.encode() == b" ".join(left)


def test_cut_repeats_carries_columns(spark, rows, empty):
    extra = ["_block", "n_words", "in_text", "spans"]
    found = substring.cut_repeats(table(spark, rows, extra))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
    got = {r.doc_id: r for r in found.collect()}
    assert 40 not in got and 41 not in got  # exact copies lose every word
    assert got[3].text == rows[3][1] and got[46].text is None and got[3]["_block"] == "own"
    assert len(got[44].text) == got[44].n_chars < len(rows[44][1])
    assert substring.cut_repeats(empty).count() == 0


def test_hashes_know_order_and_borders():
    s = substring.Suffixes([b"a b c", b"a bc", b"ab c", b"c b a", b"a b c"], window=2)
    assert len(np.unique(s.prefix(2))) == 6  # a b, b c, a bc, ab c, c b, b a
    words = [b"x" * n for n in range(1, 600)] + [b"x" * n + b"y" for n in range(600)] + [b"y" * 8 + b"x", b"x" * 8 + b"\0", b"x" * 8]
    h, doc = substring.word_hashes(words)
    assert len(h) == len(doc) == len(words) and len(np.unique(h)) == len(set(words))
    parts = substring.word_hashes(words, most=100)
    assert (parts[0] == h).all() and (parts[1] == doc).all()
    assert (substring.word_hashes(words, seed=1)[0] != h).all()
