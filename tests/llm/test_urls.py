import pytest

from tidelog.llm import urls


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('host', id, '.example.org') as key")
    listed = universe.filter("xxhash64(key) % 7 = 0")
    levels = urls.build_cascade(listed.union(listed), universe.union(universe))
    assert len(levels) >= 2
    want = {r.key for r in listed.collect()}
    got = {r.key for r in universe.filter(urls.is_listed(universe.key, levels)).collect()}
    assert got == want


def test_levels_alternate_for_a_short_list(spark):
    """Six of sixty hosts need several levels; without the odd ones other hosts would be listed, without the later even ones listed hosts would be lost."""
    universe = spark.range(600).selectExpr("concat('h', id % 60, '.example.net') as key")
    listed = universe.filter("cast(substring_index(substring(key, 2), '.', 1) as int) < 6")
    levels = urls.build_cascade(listed, universe)
    want = {f"h{i}.example.net" for i in range(6)}
    shown = lambda some: {r.key for r in universe.filter(urls.is_listed(universe.key, some)).collect()}
    assert len(levels) >= 2 and shown(levels) == want
    assert shown(levels[:1]) > want


def test_no_keys_and_null(spark):
    universe = spark.createDataFrame([("a",), (None,)], "key string")
    assert urls.build_cascade(universe.limit(0), universe) == []
    assert universe.filter(urls.is_listed(universe.key, [])).count() == 0
    found = {r.key: r.listed for r in urls.listed_among(universe, "key", universe, universe).collect()}
    assert found == {"a": True, None: False}


@pytest.mark.parametrize(("max_keys", "max_parts", "ways"), [(1000, 8, 1), (40, 8, 4), (40, 2, None)])
def test_a_long_list_is_split_or_joined(spark, max_keys, max_parts, ways):
    universe = spark.range(900).selectExpr("concat('host', id % 700) as key", "'own' as listed_key")
    listed = universe.filter("xxhash64(key) % 5 = 0").select("key")
    parts = urls.build_parts(listed, universe.select("key"), max_keys, max_parts)
    assert parts is None if ways is None else len(parts) >= ways
    want = {r.key for r in listed.collect()}
    found = urls.listed_among(universe, "key", listed, universe.select("key"), max_keys, max_parts)
    rows = found.collect()
    assert found.columns == ["key", "listed_key", "listed"] and len(rows) == 900
    assert all(r.listed == (r.key in want) for r in rows)


def test_whole_query_on_hard_pages(spark, tmp_path):
    long = "http://m.casino-win.org/" + "a/" * 100_000
    pages = [(1, long), (2, long), (2, "x://spam-farm.org"), (3, None), (4, "http://clean.org/?http://ads-track.org"), (5, "http://notspam-farm.org/"), (6, "HTTP://SPAM-FARM.ORG:80/")]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'own' as host", "'own' as verdict", "'<p>' as html")
    df.write.parquet(f"{tmp_path}/a/pages.parquet")
    got = sorted((r.page_id, r.host, r.verdict, len(r.path)) for r in urls.op7_url_filters(spark, f"{tmp_path}/a").collect())
    assert got == [(1, "m.casino-win.org", "block", 200_001), (2, "m.casino-win.org", "block", 200_001), (2, "spam-farm.org", "block", 0), (3, "", "allow", 0), (4, "clean.org", "allow", 1), (5, "notspam-farm.org", "allow", 1), (6, "spam-farm.org:80", "block", 1)]
    df.limit(0).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert urls.op7_url_filters(spark, f"{tmp_path}/b").count() == 0
    judged = urls.judge(urls.with_parts(df), spark.createDataFrame([("spam-farm.org",)], "key string"))
    assert sorted(judged.columns) == sorted(["page_id", "url", "host", "path", "html", "listed", "rule", "verdict"])


def test_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "allow", "www.example.com/en/"),
        "x://example.com/en/": ("example.com", "/en/", "block", "example.com/en/"),
        "http://a.example.com/fr/": ("a.example.com", "/fr/", "allow", "com/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "allow", "com/"),
        "http://x.net/es/#f": ("x.net", "/es/", "block", "net/es/"),
        "http://x.net?u=http://y/es/": ("x.net", "", None, None),
        "http://x.org": ("x.org", "", None, None),
        "no scheme/": ("", "", None, None),
        "http:///p": ("", "/p", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    df = urls.with_parts(spark.createDataFrame([(u,) for u in cases], "url string"))
    for r in urls.judge(df, df.selectExpr("'none' as key").limit(0)).collect():
        host, path, verdict, rule = cases[r.url]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_plan_is_native(spark):
    df = urls.with_parts(spark.createDataFrame([("http://a/",)], "url string"))
    plan = urls.judge(df, df.selectExpr("host as key"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
