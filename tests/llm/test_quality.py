import random
import re

import pytest
from helpers import prose, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #\n\t\u00e9\u00a0\u2003日", max_size=80))
def test_stats_match_brute_force(text):
    assert quality.text_stats(text.encode()) == brute(text)


def test_whole_table(docs):
    found = {(r.doc_id, r.source): r for r in quality.quality_rules(docs).collect()}
    for r in docs.collect():
        f = found[r.doc_id, r.source]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute(r.text or "")
        assert f.base_failed == (f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words)
        assert not (f.kept and f.base_failed)


def hosts(spark, kinds, extra=()):
    """Documents of hosts from (host, how many, what every tenth document but the first nine is like)."""
    rng, rows = random.Random(3), []
    clean = [prose(rng, 80) for _ in range(20)]
    for host, n, share, bad in kinds:
        rows += [(len(rows) + i, bad if i % 100 < share else clean[i % 20], "en", host, 1) for i in range(n)]
    return table(spark, rows, extra)


SYMBOLS = " | ".join(f"w{i} #" for i in range(100))
LINES = "x\n" * 30 + " ".join(f"w{i}" for i in range(200))


def test_bad_host_takes_its_documents_along(spark):
    docs = hosts(spark, [("bad", 200, 90, "short"), ("good", 2000, 5, "short")], ["host_refused", "kept", "n_words", "symbols", "lines_watched"])
    found = quality.quality_rules(docs).filter("not base_failed").groupBy("source", "kept").count().collect()
    assert {(r.source, r.kept) for r in found} == {("bad", False), ("good", True)}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {(r.source, r.symbols) for r in kept.select("source", "symbols").distinct().collect()} == {("good", "own")}


def test_a_host_of_few_documents_is_judged_by_the_prior(spark):
    """Two bad documents of two do not refuse a host; two hundred of two hundred and fifty do."""
    docs = hosts(spark, [("small", 2, 100, "short"), ("large", 250, 80, "short"), *[(f"h{i}", 300, 5, "short") for i in range(20)]])
    refused = {r.source for r in quality.host_verdicts(docs.mapInArrow(quality._measure, f"doc_id long, lang string, source string, n_chars long, {quality.STATS}").withColumns(quality.failures())).filter("host_refused").collect()}
    assert refused == {"large"}


def test_the_limit_follows_the_prior(spark):
    """A rate of 40 % refuses a host among clean ones, and none where a third fails everywhere."""
    verdicts = lambda docs: {r.source: r.host_refused for r in quality.host_verdicts(docs.mapInArrow(quality._measure, f"doc_id long, lang string, source string, n_chars long, {quality.STATS}").withColumns(quality.failures())).collect()}
    among_clean = verdicts(hosts(spark, [("x", 300, 40, "short"), *[(f"h{i}", 300, 2, "short") for i in range(10)]]))
    among_poor = verdicts(hosts(spark, [("x", 300, 40, "short"), *[(f"h{i}", 300, 33, "short") for i in range(10)]]))
    assert among_clean["x"] and sum(among_clean.values()) == 1 and not any(among_poor.values())


@pytest.mark.parametrize("bad", [SYMBOLS, LINES])
def test_watched_hosts_answer_for_each_document(spark, bad):
    """Where a twentieth is junk it goes, document by document; one such text among a thousand stays."""
    docs = hosts(spark, [("watched", 500, 10, bad), ("clean", 1000, 0, bad)]).unionByName(table(spark, [(9999, bad, "en", "clean", 1), (9998, bad, "en", None, 1)]))
    found = quality.quality_rules(docs)
    by = {(r.source, r.junk): (r.n, r.kept) for r in found.groupBy("source", (F.col("symbols") | F.col("lines")).alias("junk")).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by == {("watched", True): (50, 0), ("watched", False): (450, 450), ("clean", True): (1, 1), ("clean", False): (1000, 1000), (None, True): (1, 1)}
    assert quality.keep_good(docs).count() == 450 + 1002


def test_keep_good_agrees_and_empty(docs, empty):
    kept = sorted(r.doc_id for r in quality.quality_rules(docs).filter("kept and doc_id is not null").collect())
    assert kept == sorted(r.doc_id for r in quality.keep_good(docs).filter("doc_id is not null").collect())
    assert quality.quality_rules(empty).count() == 0
    assert quality.keep_good(empty).count() == 0
