"""URL filters: rules by host and path, then a Bloom filter cascade for the hosts that no rule decides.

A cascade answers membership exactly for a known universe of keys. Level 0 is a
Bloom filter of the listed keys; level 1 holds the keys of the universe that
are not listed but pass level 0; level 2 the listed keys that pass level 1 as
well; and so on, in turn, until a level lets nothing wrong through. A key is
judged by the first level that does not hold it: after an even level it is not
listed, after an odd one it is. Every page is looked up against constants in
the plan, without a join.

Level 0 lets through about 0.7 times as many other keys as keys are listed, which
makes all levels together smallest; each further level holds what is left over
from the one before and lets an eighth of its opposite through. A level's size
follows from its count of keys, in bits, so levels act in turn for a list of six
hosts as for one of a million.

One cascade holds MAX_KEYS listed keys at most. A longer list is split by a hash of
the key into parts, each with a cascade of its own; past MAX_PARTS parts, whose
constants no plan should carry, `listed_among` joins instead. Each way is exact.

Everything is a DataFrame function: a level's words are long values, or-ed
together by position.

Defined cases: a null url, or one without "://", has an empty host and path; an
empty host is never listed; no listed key gives no level and lists nothing;
repeated urls are judged alike, and a url of any length whole; an empty table
gives no rows. `with_parts` and `judge` carry columns along; their own (host and
path; rule, verdict and listed) replace columns of the same names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Listed names: a host is listed if one of its labels is one of these.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Keys that one cascade may list: about 1.5 MB of constants. MAX_PARTS cascades may be in one plan.
MAX_KEYS = 1 << 20
MAX_PARTS = 8
#: What the levels after the first let through.
PASS = 1 / 8
#: From this level on, sizes double from level to level, so that a few unlucky keys cannot go on for ever.
LAST_STEADY = 16


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host and path."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(authority) + 1), r"^([^?#]*)", 1)
    return urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """verdict and rule (host and path) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


@dataclass
class Level:
    seed: int
    size: int  # in bits
    hashes: int
    words: list[int]  # 64 bits each

    def holds(self, key: Column) -> Column:
        """Whether the filter lets key through."""
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant by the optimizer
        out = F.lit(True)
        for bit in bits_of(key, self.seed, self.size, self.hashes):
            word = F.element_at(table, F.shiftright(bit, 6).cast("int") + 1)
            out = out & (word.bitwiseAND(_one_bit(bit)) != 0)
        return out


def _one_bit(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def bits_of(key: Column, seed: int, size: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(size)) for i in range(hashes)]


def level_shape(count: int, passing: float) -> tuple[int, int]:
    """Bits and hashes of a filter of count keys that lets that share of others through."""
    hashes = max(1, round(-math.log2(passing)))
    return max(1, math.ceil(count * hashes / math.log(2))), hashes


def build_level(keys: DataFrame, seed: int, size: int, hashes: int) -> Level:
    """The filter of all rows of keys (a column key): one bit-or for each word, and that table of fixed size comes back."""
    bit = keys.select(F.explode(F.array(*bits_of(F.col("key"), seed, size, hashes))).alias("bit"))
    found = bit.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(_one_bit(F.col("bit"))).alias("bits"))
    table = [0] * -(-size // 64)
    for r in found.collect():  # as many rows as the level has words
        table[r["word"]] = r["bits"]
    return Level(seed, size, hashes, table)


def build_cascade(listed: DataFrame, universe: DataFrame, max_keys: int = MAX_KEYS) -> list[Level]:
    """The levels for the distinct keys of listed, exact over all keys of universe (both with one column key)."""
    inside = cut(listed.filter("key is not null").distinct())
    outside = cut(universe.filter("key is not null").distinct().join(inside, "key", "left_anti"))
    levels: list[Level] = []
    holding, other = inside, outside
    count = holding.count()
    if count > max_keys:
        raise ValueError(f"{count} keys are listed; one cascade holds {max_keys} at most; build_parts splits the list")
    passing = min(0.5, max(1e-6, 0.7 * count / max(1, outside.count())))
    while count:
        size, hashes = level_shape(count, passing)
        level = build_level(holding, len(levels), size << max(0, len(levels) - LAST_STEADY), hashes)
        levels.append(level)
        holding, other = cut(other.filter(level.holds(F.col("key")))), holding
        count, passing = holding.count(), PASS
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for every key of the universe that the levels were built over."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def build_parts(listed: DataFrame, universe: DataFrame, max_keys: int = MAX_KEYS, max_parts: int = MAX_PARTS) -> list[list[Level]] | None:
    """A cascade for each part of the keys by hash, so many that each part lists max_keys at most; None if more than max_parts were needed."""
    inside = cut(listed.filter("key is not null").distinct())
    parts = max(1, -(-inside.count() // max_keys))
    while parts <= max_parts:
        most = inside.groupBy(_part(F.col("key"), parts)).count().agg(F.max("count")).first()[0] or 0
        if most <= max_keys:
            return [build_cascade(inside.filter(_part(F.col("key"), parts) == i), universe.filter(_part(F.col("key"), parts) == i), max_keys) for i in range(parts)]
        parts += 1
    return None


def listed_among(rows: DataFrame, key: str, listed: DataFrame, universe: DataFrame, max_keys: int = MAX_KEYS, max_parts: int = MAX_PARTS) -> DataFrame:
    """rows with a boolean column listed: whether their key is in the table listed (a column key). universe holds every key that rows has.

    The list is a table of any size: one cascade, several, or past max_parts a join
    with the distinct listed keys, which AQE splits where one key has many rows.
    """
    parts = build_parts(listed, universe, max_keys, max_parts)
    if parts is None:
        name = fresh(rows, "listed_key")
        keys = listed.filter("key is not null").distinct().select(F.col("key").alias(name))
        return rows.join(keys, F.col(key) == F.col(name), "left").withColumn("listed", F.col(name).isNotNull()).drop(name)
    out = F.lit(False)
    for i, levels in enumerate(parts):
        inside = is_listed(F.col(key), levels)
        out = F.when(_part(F.col(key), len(parts)) == i, inside).otherwise(out) if len(parts) > 1 else inside
    return rows.withColumn("listed", F.coalesce(out & F.col(key).isNotNull(), F.lit(False)))


def judge(urls: DataFrame, listed: DataFrame, rules: tuple = RULES, max_keys: int = MAX_KEYS, max_parts: int = MAX_PARTS) -> DataFrame:
    """urls (with host and path) with listed, rule and verdict: the longest rule's, else block for a host in the table listed (a column key)."""
    universe = urls.select(F.col("host").alias("key"))
    found = listed_among(urls, "host", listed.filter("key <> ''"), universe, max_keys, max_parts)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return found.withColumns({"verdict": F.coalesce(rule["verdict"], own), "rule": rule["rule"]})


def hosts_with_names(urls: DataFrame, names: tuple[str, ...] = LISTED_NAMES) -> DataFrame:
    """The list that comes from names: every host (a column key) of urls that has one of them as a label."""
    return urls.select(F.col("host").alias("key")).filter(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, names)))).distinct()


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_parts(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judge(pages, hosts_with_names(pages)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS authority FROM r),
p AS (
  SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(authority) + 1), '^([^?#]*)', 1) AS path FROM a),
rules(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
found AS (
  SELECT page_id, arg_max(verdict, length(h || q)) AS verdict, arg_max(h || q, length(h || q)) AS rule
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN found USING (page_id)
"""
