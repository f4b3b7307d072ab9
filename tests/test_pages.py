"""Places and addresses of pages against a plain numbering, with many names of one base and in several ranges."""

from feedloom.operators import pages


def test_addresses_of_equal_bases(spark):
    marks = ["a/b", "a b", "a?b", "a:b", "a*b", "a.b", "a,b", "a!b", "a(b", "a)b", "a[b", "a'b"]
    names = [*marks, "a-b-2", "a-b-3", "c", "c-2", "???", "!!!", *(f"x{i}" for i in range(60)), "x 7", "x/7", "x?7"]
    works = [[w] for w in names for _ in range(2 + (len(w) == 1))]
    got = pages.work_pages(spark.createDataFrame([(w,) for w in works], "works array<string>").repartition(7)).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, len(names) + 1)) and sorted(r["name"] for r in got) == sorted(names)
    assert [r["n"] for r in got] == sorted((r["n"] for r in got), reverse=True) and got[0]["name"] == "c"
    bases = dict(spark.createDataFrame([(w,) for w in names], "name string").select("name", pages.base_slug(pages.F.col("name"))).collect())
    used = set()
    for r in got:
        slug, k = bases[r["name"]], 2
        while slug in used:
            slug, k = f"{bases[r['name']]}-{k}", k + 1
        used.add(slug)
        assert r["slug"] == slug
    assert pages.work_pages(spark.createDataFrame([], "works array<string>")).collect() == []


def test_places_run_on_over_ranges(spark):
    df = spark.range(0, 5000).selectExpr("id * 7919 % 5000 AS v").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pages.in_ranges(df, "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["v"], r["idx"]) for r in got) == [(i, i) for i in range(5000)]
