import hashlib
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from helpers import planted, prose, table, write
from test_packing import check_places
from test_simhash import jaccard
from tokenizers import Tokenizer

from tidelog.llm import mixing, packing, quality
from tidelog.llm.common import shared_folder


def test_stages(spark, tmp_path):
    rows = planted(n=60)
    rows = [*rows, rows[0]]
    write(spark, tmp_path, "documents", table(spark, rows, ["extra"]))
    write(spark, tmp_path, "labels", spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = docs
        if k < 4:
            assert docs.columns == columns
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    assert set(range(60)) <= ids("quality rules")
    assert ids("quality rules") & {66, 67, 68} == set()  # no words
    assert 60 not in ids("simhash near-dedup") and 61 not in ids("simhash near-dedup") and 3 in ids("simhash near-dedup")
    assert set(range(60)) <= ids("substring dedup")
    final = seen["best-fit packing"]
    assert {r.doc_id for r in final.collect()} == ids("mixing to target weights")
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_over_empty_tables(spark, tmp_path):
    write(spark, tmp_path, "documents", table(spark, []))
    write(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_quality(rows):
    """Whom the first stage keeps, from the figures of test_quality's brute force and the rules' words."""
    from test_quality import brute

    figures = {i: brute(r[1] or "") for i, r in enumerate(rows)}
    fails = {}
    for i, (n, chars, marks, dup, repeated) in figures.items():
        fails[i] = (n < 50 or 100 * repeated > 50 * n, 10 * marks > chars, 10 * dup > n)
    refused, watched = set(), {}
    for rule in range(3):
        hosts = {}
        for i, r in enumerate(rows):
            if r[3] is not None:
                hosts.setdefault(r[3], []).append(fails[i][rule])
        n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
        a, b = quality.beta_prior(n, f, len(hosts), sum(sum(x) ** 2 / len(x) for x in hosts.values()))
        limit = max(0.2, 4 * a / b / (1 + 4 * a / b))
        for h, x in hosts.items():
            rate = (sum(x) + a) / (len(x) + a + b)
            if rate - 1.645 * (rate * (1 - rate) / (len(x) + a + b + 1)) ** 0.5 > limit:
                refused.add(h)
            watched[h, rule] = rate >= 0.02
    return [r for i, r in enumerate(rows) if not fails[i][0] and r[3] not in refused and not any(fails[i][k] and watched.get((r[3], k)) for k in (1, 2))]


def brute_dedup(rows):
    """The smallest of each group of documents that chains of pairs of Jaccard 0.8 or more connect."""
    ids = [r[0] for r in rows]
    label = dict(zip(ids, ids, strict=True))
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(a[1], b[1]) >= 0.8]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return [r for r in rows if label[r[0]] == r[0]]


def brute_cut(rows):
    from test_substring import brute

    gone = {i: (n, removed, sha) for i, n, removed, sha in brute([(r[0], r[1]) for r in rows])}
    return {i: sha if removed else None for i, (n, removed, sha) in gone.items() if not n or removed < n}


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage over what the one before kept: the same rows as its brute force, and packing and mixing by their rules."""
    rows = planted(seed=11, n=50) + [(100 + i, r[1] + " an end of its own", "en", "src1", 1) for i, r in enumerate(planted(seed=11, n=50)[:10])]
    rows = [r for r in rows if len(r[1] or "") < 50_000]
    write(spark, tmp_path, "documents", table(spark, rows))
    write(spark, tmp_path, "labels", spark.createDataFrame([(i, int(i % 5 > 0), int(i % 11 == 0)) for i in range(50)], "doc_id long, quality int, toxic int"))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/b{k}")
        docs = spark.read.parquet(f"{tmp_path}/b{k}")
        seen.append(docs.collect())
    kept = brute_quality(rows)
    assert sorted(r.doc_id for r in seen[0]) == sorted(r[0] for r in kept)
    kept = brute_dedup(kept)
    assert sorted(r.doc_id for r in seen[1]) == sorted(r[0] for r in kept) and len(seen[1]) < len(seen[0])
    want, source = brute_cut(kept), {r[0]: r[1] for r in kept}
    got = {r.doc_id: r.text for r in seen[2]}
    assert set(got) == set(want) and any(want.values())
    for i, sha in want.items():
        assert got[i] == source[i] if sha is None else hashlib.sha256(got[i].encode()).hexdigest() == sha

    before = spark.read.parquet(f"{tmp_path}/b2")
    labels = mixing.label_domains(spark.read.parquet(f"{tmp_path}/labels.parquet"))
    copies = {r.doc_id: r.copies for r in mixing.fit_mixture(before, labels, mixing.TARGETS).collect()}
    assert Counter(r.doc_id for r in seen[3]) == Counter({i: n for i, n in copies.items() if n})
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    lengths = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in got.items()}
    assert Counter({i: sum(r.length for r in seen[4] if r.doc_id == i) for i in got}) == Counter({i: n * lengths[i] for i, n in copies.items()})
    check_places(seen[4], 4096)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r.doc_id for r in seen[4])


def test_stages_bear_hard_rows(spark, tmp_path):
    """Rows without an id, repeated rows and ids, columns with the operators' own names."""
    rows = planted(seed=12, n=30)
    alone = prose(random.Random(13), 90)
    rows += [rows[0], (None, alone, None, None, None), (None, rows[2][1], "en", "src0", 1), (3, rows[5][1], "en", "src0", 1)]
    names = ["text_hash", "_block", "block", "rate", "n_words", "kept", "symbols", "spans", "component_id", "grp", "host_refused"]
    write(spark, tmp_path, "documents", table(spark, rows, names))
    write(spark, tmp_path, "labels", spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/h{k}")
        docs = spark.read.parquet(f"{tmp_path}/h{k}")
        if k < 4:
            assert docs.columns == columns and docs.select(*names).distinct().collect() == [("own",) * len(names)]
    assert docs.filter("doc_id is null").count() == 1  # the other one's words are all in a document with an id


def test_run_removes_what_was_read(spark, tmp_path):
    write(spark, tmp_path, "documents", table(spark, planted(n=20)))
    write(spark, tmp_path, "labels", spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("pipeline-*"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    (new,) = set(shared.glob("pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == ["3"]
