import random

import numpy as np
import pytest
import xxhash
from helpers import prose, table

from tidelog.llm import graph, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, f in zip(ids, fps, strict=True):
            for j, g in zip(ids, fps, strict=True):
                if (f ^ g).bit_count() <= 4 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(0)
    anchors = simhash.Golay(4)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(len(x), bool)
    for first, width in simhash.SEGMENTS:
        cut = lambda v: ((v >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)  # noqa: B023, E731
        i, a, home = anchors.near(cut(x))
        j, b, _ = anchors.near(cut(y))
        assert np.bincount(i[home], minlength=len(x)).tolist() == [1] * len(x)
        seen = set(zip(j.tolist(), b.tolist(), strict=True))
        met |= np.array([pair in seen for pair in zip(i[home].tolist(), a[home].tolist(), strict=True)])
    assert met.all()


def test_documents(docs):
    rows = docs.collect()
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows if r.doc_id is not None}
    want = brute_components(list(fps), list(fps.values()))
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == want
    assert found[41].component_id == 3 and found[47].component_id == found[46].component_id == 46


def test_chain_of_links_is_one_component(spark):
    values = [sum(1 << (b % 64) for b in range(4 * k)) for k in range(17)]  # each 4 bits from the next
    fp = np.array(values, np.uint64).view(np.int64)
    links = simhash.anchor_links(fp, np.arange(17), np.ones(17, bool))
    assert len(links) == 16
    edges = spark.createDataFrame([(a, b) for a, b in links] + [(30, 31), (31, 30), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert {found[i] for i in range(17)} == {0} and found[31] == 30


def close_pairs(rng, n, most):
    x = rng.integers(0, 1 << 63, n).astype(np.uint64)
    y = x.copy()
    for i in range(n):
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    return x, y


def test_finer_covers_bring_every_close_pair_together():
    x, y = close_pairs(np.random.default_rng(1), 300, 4)
    for shared, width in ((2, 20), (4, 32)):
        met = np.zeros(len(x), bool)
        cover = simhash.parts_cover(4, shared)
        for (i, a, _), (_, b, _) in zip(cover(x), cover(y), strict=True):
            assert (i == np.arange(len(x))).all()
            met |= a == b
        assert met.all()
        assert len(list(simhash.parts_cover(4, shared)(x))) == {2: 15, 4: 70}[shared] and len(np.unique(a)) > 290, width


def test_peeling_finds_the_components_of_all_links():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fp = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centres] + [rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    fp = np.unique(fp)
    want = brute_components(range(len(fp)), fp.tolist())
    for links in (simhash.peel_links(fp.view(np.int64), np.arange(len(fp))), simhash.anchor_links(fp.view(np.int64), np.arange(len(fp)), np.ones(len(fp), bool))):
        assert len(links) == len(fp) - len(set(want.values()))
        assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in links)
        label = list(range(len(fp)))
        for _ in range(len(fp)):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            if [label[a] for a, _ in links] == [label[b] for _, b in links]:
                break
        assert label == [want[i] for i in range(len(fp))]


@pytest.mark.parametrize("most_rows", [1, 3, 20, 1 << 20])
def test_crowded_anchors_lose_no_link(spark, most_rows):
    """A cluster of a third of all rows, chains, pairs and strangers: each cover, alone or after others, gives the same components."""
    rng = np.random.default_rng(3)
    x, y = close_pairs(rng, 60, 4)
    centre = rng.integers(0, 1 << 63)
    cluster = [int(centre) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))]
    fps = list(dict.fromkeys([*x.tolist(), *y.tolist(), *cluster]))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long").repartition(3)
    found = {r.node: r.component for r in graph.components(simhash.links_within(nodes, 4, most_rows)).collect()}
    want = brute_components(range(len(fps)), fps)
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_comparisons_follow_the_rows():
    """Rows that one meets at all its anchors, at ten times the rows: the finer cover takes over where the first would be crowded."""
    rng, met = np.random.default_rng(4), []
    for n in (200_000, 2_000_000):
        fp = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        rows = 5.32 * n / 4096
        if rows <= simhash.MOST_ROWS / 4:  # the largest anchors of such random points have some four times the mean
            met.append(3 * rows)
        else:
            sizes = [np.bincount(np.unique(a, return_inverse=True)[1]) for _, a, _ in simhash.parts_cover(4, 2)(fp[:n])]
            met.append(sum(float((s.astype(float) ** 2).sum()) / n for s in sizes))
    assert met[1] <= met[0] < 1000


def jaccard(a, b):
    x, y = (simhash.shingle_set((t or "").encode(), 5) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def near_copies(n=60, seed=5):
    """Originals, copies with a fiftieth of their words changed (Jaccard over 0.8), and with a tenth changed (under)."""
    rng, rows = random.Random(seed), []
    originals = [prose(rng, rng.randint(100, 300)).split() for _ in range(n)]
    for share, copies in ((0.0, originals), (0.018, originals), (0.018, originals[:20] * 2), (0.1, originals)):
        for words in copies:
            changed = set(rng.sample(range(len(words)), int(share * len(words))))
            rows.append((len(rows), " ".join(prose(rng, 1) + "q" if i in changed else w for i, w in enumerate(words)), "en", "s", 1))
    return rows


def test_the_stage_takes_similar_documents_and_leaves_the_rest(spark):
    rows = near_copies()
    texts = {r[0]: r[1] for r in rows}
    pairs = [(i, j) for i in texts for j in texts if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, rows)).collect()}
    assert len(pairs) > 90
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.95 * len(pairs)
    groups = {}
    for i, c in found.items():
        groups.setdefault(c, []).append(i)
    for members in groups.values():  # whoever is in a group is similar to another in it
        assert all(any(jaccard(texts[i], texts[j]) >= 0.8 for j in members if j != i) for i in members) or len(members) == 1
    kept = {r.doc_id for r in simhash.keep_first(table(spark, rows, ["text_hash", "node", "component_id", "a"])).collect()}
    assert kept == {i for i, c in found.items() if i == c}


@pytest.mark.parametrize(("seed", "rows_of_block"), [(0, 512), (3, 7), (6, 30)])
def test_a_crowd_of_near_texts_loses_no_similar_pair(spark, seed, rows_of_block):
    """80 texts, all within the bits of the stage; those over and under the limit are mixed, so three partners a row are too few."""
    rng = random.Random(seed)
    words, rows = prose(rng, 400).split(), []
    for i in range(80):
        mine = list(words)
        for at in rng.sample(range(400), 5):
            mine[at] = f"w{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(mine), "en", "s", 0))
    rows += [(100 + i, prose(rng, 100), "en", "s", 0) for i in range(10)]
    label = {r[0]: r[0] for r in rows}
    sets = {r[0]: simhash.shingle_set(r[1].encode(), 5) for r in rows}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((label[i], label[j]))
        label = {k: a if x == b else x for k, x in label.items()}
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, rows), rows_of_block=rows_of_block).collect()}
    assert len(pairs) > 400 and found == label


def test_few_near_rows_are_all_candidates_and_more_are_marked():
    fp = np.array([0, 1, 2, 4, *(1 << 40 ^ 1 << k for k in range(6)), -1], np.int64) ^ np.array([0] * 4 + [0x0F0F0F0F] * 6 + [0], np.int64)
    found = set(simhash.candidate_links(fp, fp, np.arange(11), 8))
    assert {(i, j) for i in range(4) for j in range(i)} == {(a, b) for a, b in found if a < 4}
    assert {a for a, b in found if a == b} == set(range(4, 10)) and all(4 <= b for a, b in found if a >= 4)


def test_a_row_of_a_shared_id_goes_by_its_own_text(spark):
    rng = random.Random(6)
    one, two = prose(rng, 200), prose(rng, 200)
    rows = [(5, one, None, None, None), (5, two, None, None, None), (3, two, None, None, None), (9, one, None, None, None)]
    kept = sorted((r.doc_id, r.text == one) for r in simhash.keep_first(table(spark, rows)).collect())
    assert kept == [(3, False), (5, True)]


def test_shape_of_the_stage_follows_the_corpus():
    for n in (10, 10_000, 10_000_000, 10_000_000_000):
        width, tables, bits = simhash.stage_shape(n)
        assert n / 2**width <= 2 * simhash.COMPANY and tables < 600 and 24 <= bits <= 32, n


def test_keep_first_and_empty(docs, empty):
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert 3 in kept and 40 not in kept and 41 not in kept and None in kept and kept.count(0) == 2
    assert simhash.keep_first(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(TypeError, match="integer"):
        simhash.near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast("string")))
