"""Quality rules: rules of each document, and verdicts on the hosts that documents come from.

Every document is measured over its whole text and held against three rules: the
base rules (too short, or too much of it repeated), symbols (over a tenth of
the characters of its words) and repeated lines (more than one for ten words).
Each rule's failures are counted by host, and a host's failure rate is shrunk
towards an empirical beta prior of that rule (moments over all hosts). A rule
gives each host one of three verdicts:

* refused: the host's odds to fail are, with a probability of about 95 %, more
  than ODDS times those of the prior's mean, and its rate is over LEAST_RATE.
  All its documents go.
* watched: the shrunk rate is at least WATCH_RATE. Of such a host, documents that
  fail the rule themselves go too.
* else a failure of symbols or repeated lines is forgiven: one table of numbers
  on a host of prose is no reason to drop it.

The limit so follows the prior: where a third of everything fails, a host must be
far worse than that to be refused.

Defined cases: a null or empty text has no words, so it fails the base rules; a
null source belongs to no host and is judged by the base rules only; rows with the
same doc_id are judged one by one; an empty table gives no rows. `quality_rules`
reads doc_id, text and source only; `keep_good` carries every column along,
whatever its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, join_checked, slices, table, text_bytes

#: Fixed values of the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: The rules that hosts are held to: base_failed, and the two below.
RULES = ("base", "symbols", "lines")
#: Symbols may be a tenth of the characters, repeated lines one for ten words.
SHARE = 10
#: A host is refused if its odds to fail a rule are surely more than so many times the prior's, and its rate over the least.
ODDS, LEAST_RATE = 4.0, 0.2
#: Standard deviations of the posterior that "surely" leaves out: about 95 % of a normal distribution lie above.
SURELY = 1.645
#: From this shrunk rate on, a host's documents answer for symbols and lines themselves.
WATCH_RATE = 0.02

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NOT_SYMBOL = bytes(x for x in range(256) if x not in SYMBOLS)
_INNER = bytes(range(0x80, 0xC0))


def text_stats(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one UTF-8 text."""
    words = raw.split()  # ASCII white space, which is the contract's
    n = len(words)
    word_chars = len(raw.translate(None, SPACE + _INNER))
    n_symbols = len(raw.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        covered = 0  # words before this one are counted already
        marks = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marks[j] = marks[i] = 1
        for i in [m.start() for m in re.finditer(b"\x01", marks)]:
            repeated += i + 3 - max(covered, i)
            covered = i + 3
    return n, word_chars, n_symbols, dup, repeated


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 8 << 20):
        found = list(zip(*map(text_stats, text_bytes(batch.column("text"))), strict=True))
        names = [x.split()[0] for x in STATS.split(", ")]
        keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, pa.int64()) for x in found)], [*kept, *names])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def failures() -> dict[str, Column]:
    """Whether a document fails each rule, from its figures."""
    return {"base": base_failed(), "symbols": SHARE * F.col("n_symbols") > F.col("word_chars"), "lines": SHARE * F.col("n_dup_lines") > F.col("n_words")}


def host_verdicts(stats: DataFrame, odds: float = ODDS, least_rate: float = LEAST_RATE, watch_rate: float = WATCH_RATE) -> DataFrame:
    """source, host_docs, host_refused and, for each rule, <rule>_rate (shrunk) and <rule>_watched of every named host.

    stats: source and a boolean column for each rule. Counts are combined before the
    shuffle, so a host of any size is a row for each task. A prior's mean is the
    rate over all documents of named hosts; its strength follows from how much more
    host rates vary than binomial chance alone would make them. Hosts that vary no
    more get the strength of 10,000 documents.
    """
    counts = [F.sum(F.col(r).cast("long")).alias(f"{r}_failed") for r in RULES]
    hosts = stats.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("host_docs"), *counts)
    squares = [F.sum(F.col(f"{r}_failed") * F.col(f"{r}_failed") / F.col("host_docs")).alias(f"{r}_squares") for r in RULES]
    total = hosts.agg(F.sum("host_docs").alias("n"), F.count("*").alias("h"), *[F.sum(f"{r}_failed").alias(f"{r}_failed") for r in RULES], *squares).first()
    refused, columns = F.lit(False), []
    for r in RULES:
        alpha, beta = beta_prior(total["n"] or 0, total[f"{r}_failed"] or 0, total["h"] or 0, total[f"{r}_squares"] or 0.0)
        prior_odds = alpha / beta
        limit = max(least_rate, odds * prior_odds / (1 + odds * prior_odds))
        weight = F.col("host_docs") + F.lit(alpha + beta)
        rate = (F.col(f"{r}_failed") + F.lit(alpha)) / weight
        spread = F.sqrt(rate * (1 - rate) / (weight + 1))
        refused = refused | (rate - SURELY * spread > limit)
        columns += [rate.alias(f"{r}_rate"), (rate >= watch_rate).alias(f"{r}_watched")]
    return hosts.select("source", "host_docs", refused.alias("host_refused"), *columns)


def beta_prior(n: int, failed: int, hosts: int, failed_times_rate: float) -> tuple[float, float]:
    """alpha and beta by moments from totals over hosts (failed_times_rate: sum of failed * failed / docs)."""
    if not n:
        return 1.0, 1.0
    m = failed / n
    if not 0 < m < 1:
        return max(m, 0.01), max(1 - m, 0.01)
    spread = failed_times_rate / n - m * m  # document-weighted variance of the hosts' rates
    between = spread - m * (1 - m) * (hosts - 1) / n
    strength = 10_000.0 if between <= 0 else min(10_000.0, max(1.0, m * (1 - m) / between - 1))
    return m * strength, (1 - m) * strength


def _kept() -> Column:
    """From a document's rules and its host's verdicts, which are null without a host."""
    out = ~F.col("base") & ~F.coalesce("host_refused", F.lit(False))
    for r in RULES[1:]:
        out = out & ~(F.col(r) & F.coalesce(f"{r}_watched", F.lit(False)))
    return out


_VERDICTS = ("host_refused", *(f"{r}_watched" for r in RULES[1:]))


def quality_rules(docs: DataFrame, odds: float = ODDS, least_rate: float = LEAST_RATE, watch_rate: float = WATCH_RATE) -> DataFrame:
    """doc_id, source, the base figures, base_failed, a column for each rule, the host's verdicts and kept of every row of docs."""
    read = docs.select("doc_id", "source", "text")
    stats = cut(read.mapInArrow(_measure, f"{_ddl(read, 'doc_id', 'source')}, {STATS}").withColumns(failures()))
    hosts = cut(host_verdicts(stats, odds, least_rate, watch_rate)).select("source", *_VERDICTS)
    return join_checked(stats, hosts, ["source"], "left").withColumns({"kept": _kept(), "base_failed": F.col("base")})


def _ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def keep_good(docs: DataFrame, odds: float = ODDS, least_rate: float = LEAST_RATE, watch_rate: float = WATCH_RATE) -> DataFrame:
    """The rows of docs, all their columns, that `quality_rules` keeps.

    The text is measured twice rather than shuffled: once for the hosts' counts and
    once where the row is kept or dropped. Only the few numbers of a row's rules
    meet its host's verdicts.
    """
    read = docs.select("source", "text")
    stats = read.mapInArrow(_measure, f"{_ddl(read, 'source')}, {STATS}").select("source", *[c.alias(r) for r, c in failures().items()])
    hosts = cut(host_verdicts(stats, odds, least_rate, watch_rate)).select("source", *_VERDICTS)
    own = {n: fresh(docs, n) for n in (*RULES[1:], *_VERDICTS)}

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that pass the base rules, with what they fail besides."""
        for batch in slices(batches, "text", 8 << 20):
            good, symbols, lines = [], [], []
            for n, chars, marks, dup, repeated in map(text_stats, text_bytes(batch.column("text"))):
                good.append(not (n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n))
                symbols.append(SHARE * marks > chars)
                lines.append(SHARE * dup > n)
            both = batch.append_column(own["symbols"], pa.array(symbols, pa.bool_())).append_column(own["lines"], pa.array(lines, pa.bool_()))
            yield both.filter(pa.array(good, pa.bool_()))

    marked = docs.mapInArrow(passing, T.StructType([*docs.schema.fields, *(T.StructField(own[r], T.BooleanType()) for r in RULES[1:])]))
    verdicts = hosts.select("source", *[F.col(v).alias(own[v]) for v in _VERDICTS])
    kept = ~F.coalesce(F.col(own["host_refused"]), F.lit(False))
    for r in RULES[1:]:
        kept = kept & ~(F.col(own[r]) & F.coalesce(F.col(own[f"{r}_watched"]), F.lit(False)))
    return join_checked(marked, verdicts, ["source"], "left").filter(kept).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (
  SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
often AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows JOIN often USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
  GROUP BY doc_id),
stats AS (
  SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM stats),
rules AS (SELECT *, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > n_words AS lines FROM judged),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, rule, sum(f::INT)::DOUBLE AS f
  FROM (SELECT source, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, symbols, lines]) AS f FROM rules WHERE source IS NOT NULL) GROUP BY source, rule),
total AS (SELECT rule, sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS h, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ^ 2 AS spread FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, CASE WHEN m > 0 AND m < 1 THEN m * strength ELSE greatest(m, 0.01) END AS a, CASE WHEN m > 0 AND m < 1 THEN (1 - m) * strength ELSE greatest(1 - m, 0.01) END AS b
  FROM (SELECT *, CASE WHEN spread - m * (1 - m) * (h - 1) / n <= 0 THEN 10000.0
                       ELSE least(10000.0, greatest(1.0, m * (1 - m) / (spread - m * (1 - m) * (h - 1) / n) - 1)) END AS strength FROM total)),
rates AS (
  SELECT source, rule, (f + a) / (n + a + b) AS rate, n + a + b AS weight, greatest(0.2, (4 * a / b) / (1 + 4 * a / b)) AS most FROM hosts JOIN prior USING (rule)),
verdict AS (
  SELECT source, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > most) AS refused,
         bool_or(rule = 'symbols' AND rate >= 0.02) AS symbols_watched, bool_or(rule = 'lines' AND rate >= 0.02) AS lines_watched
  FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(refused, false) AND NOT (symbols AND coalesce(symbols_watched, false)) AND NOT (lines AND coalesce(lines_watched, false)) AS kept
FROM rules LEFT JOIN verdict USING (source)
"""
