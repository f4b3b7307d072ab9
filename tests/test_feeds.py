"""Feed source, files, sinks, schedules, query state and the streaming archive, on small cases."""

import random
import urllib.error

import pytest

from feedloom.functions.feed_query import FeedQuery
from feedloom.functions.schedule import announcements
from feedloom.sources import feeds, sinks
from feedloom.streaming import archive

RSS = b"""<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>no item</title>
<item><title>A &amp; B</title><link>https://e.org/1</link><pubDate>Tue, 02 Jan 2024 00:00:00 +0900</pubDate><description>x &lt;img src="https://e.org/pixel.gif"&gt;</description><media:thumbnail url="https://e.org/t.png"/></item>
<item><title></title><link>https://e.org/2</link></item><item><title>No web link</title><link>ftp://e.org</link></item>
<item><title>Bad date</title><link>http://e.org/3</link><dc:date>soon</dc:date><enclosure type="image/png" url="http://e.org/no.png"/></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="https://e.org/s"/><link href="https://e.org/a"/><updated>2024-01-01T15:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_entries():
    assert list(feeds.entries(RSS)) == [("A & B", "https://e.org/1", 1704121200, 'x <img src="https://e.org/pixel.gif">', "https://e.org/t.png"), ("Bad date", "http://e.org/3", None, "", None)]
    assert list(feeds.entries(ATOM)) == [("T", "https://e.org/a", 1704121200, "s", None)]


def test_retry_and_fallbacks():
    asked, waits = [], []

    def get(url):
        asked.append(url)
        if url == "busy":
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        return b"<broken" if url == "broken" else ATOM

    feed = {"id": "f", "url": "busy", "fallbacks": [{"via": "relay", "url": "broken"}, {"via": "other", "url": "good"}]}
    assert [r[:4] for r in feeds.read_feed(feed, get, waits.append)] == [("f", "other", 0, "T")]
    assert asked == ["busy", "busy", "broken", "good"] and waits == [30]
    assert next(feeds.read_feed({"id": "f", "url": "busy"}, get, waits.append))[-1].startswith("HTTPError")


def test_data_source_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_bytes(RSS)
    (tmp_path / "b.xml").write_bytes(ATOM)
    (tmp_path / "c.xml").write_bytes(b"<oops")
    rows = feeds.scan(spark, [{"id": "a", "url": f"file://{tmp_path}/in/a.xml"}, {"id": "b", "url": f"file://{tmp_path}/b.xml", "limited": True}, {"id": "c", "url": f"file://{tmp_path}/c.xml"}]).collect()
    assert sorted((r["feed"], r["title"]) for r in rows if r["title"]) == [("a", "A & B"), ("a", "Bad date"), ("b", "T")]
    assert [r["feed"] for r in rows if r["error"]] == ["c"]
    stored = feeds.stored_feeds(spark, str(tmp_path)).collect()
    assert sorted(r["title"] for r in stored if r["title"]) == ["A & B", "Bad date", "T"] and sum(r["error"] is not None for r in stored) == 1
    assert feeds.stored_or_empty(spark, f"{tmp_path}/none", "a long").count() == 0


def test_rss_and_replace(spark, tmp_path):
    x = spark.createDataFrame([(1, "f<", "a&b\x01", "https://e.org/1", 0, "s"), (2, "f<", "c", "https://e.org/2", None, None), (3, None, "d", "https://e.org/3", 1, "")], "ord long, src string, title string, link string, pub long, summary string")
    (r,) = sinks.rss_documents(x, "src").collect()
    assert r["feed"] == "f<" and [e[:3] for e in feeds.entries(r["xml"].encode())] == [("a&b", "https://e.org/1", 0), ("c", "https://e.org/2", None)]
    path = f"{tmp_path}/t"
    sinks.replace_archive(x, path)
    sinks.replace_archive(feeds.stored_or_empty(spark, path, "ord long, title string").where("ord < 3"), path)
    schema = "ord long, title string"
    assert feeds.stored_or_empty(spark, path, schema).count() == 2 and len(feeds.versions(spark, path)) == 1
    # a version that was not finished counts as little as one that can't be read
    (tmp_path / "t" / "version=000000007").mkdir()
    assert feeds.stored_or_empty(spark, path, schema).count() == 2
    (tmp_path / "t" / "version=000000008").mkdir()
    (tmp_path / "t" / "version=000000008" / "_SUCCESS").touch()
    (tmp_path / "t" / "version=000000008" / "part-0.parquet").write_bytes(b"PAR1 no")
    assert feeds.stored_or_empty(spark, path, schema).count() == 2 and feeds.stored_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    assert sinks.site_map(spark.createDataFrame([("/a?b&c", 0)], "loc string, lastmod long")).first()[0] == "<url><loc>/a?b&amp;c</loc><lastmod>1970-01-01T00:00:00Z</lastmod></url>"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7月14日発売、8月1日に配信開始", [("2024-07-14", "release"), ("2024-08-01", "start")]),
        ("1/5 launch", [("2025-01-05", "release")]),
        ("8月中旬に開催", [("2024-08", "event")]),
        ("2026年2月31日発売 2026年2月31日発売", [("2026-02-31", "release")]),
        ("本日発売", [("2024-07-01", "release")]),
        ("7月14日まで開催", []),
        ("7月14日発売した", []),
        ("7月14日発売延期", []),
        ("7月14日に抽選、発売", []),
        ("7月14日。発売", []),
        ("13/40 launch", []),
        ("7月14日" + "あ" * 20 + "発売", []),
        ("", []),
        (None, []),
    ],
)
def test_announcements(text, want):
    assert announcements(text, 1719800000) == want  # 2024-07-01 in the rules' time


def test_announcements_without_time():
    assert announcements("7/14 launch, 2024年7月14日 launch, today ends", None) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("『夜の駅』で12月10日配信", [("2024-12-10", "start")]), ("『駅』2027年2月19日発売決定", [("2027-02-19", "release")]), ("『駅』Disc版が本日発売", [("2024-07-01", "release")]), ("体験版を10月1日より配信", [("2024-10-01", "start")]),
        ("9月30日まで50%オフ開催", []), ("9月30日（水）まで開催", []), ("9月30日 〆 開催", []), ("10月1日にPV公開・配信", []), ("5月1日に発売された新作が累計100万本", []), ("5日目（7月21日）の開催中止", []),
        ("12月10日発売見送り", []), ("12月 10日発売", [("2024-12-10", "release")]), ("１２月１０日発売", [("2024-12-10", "release")]), ("1月期配信開始", [("2025-01", "start")]), ("12/25/3 launch", []), ("本日限定の品を発売", []), ("12月10日開催、発売", [("2024-12-10", "event")]),
    ],
)
def test_announcements_that_count_and_do_not(text, want):
    assert announcements(text, 1719800000) == want


def test_long_texts_of_dates_are_linear():
    import time

    took = []
    for n in (2000, 16000):
        begin = time.process_time()
        announcements("12/10 launch " * n, 1719800000)
        took.append(time.process_time() - begin)
    assert took[1] < 20 * max(took[0], 0.02)


@pytest.mark.parametrize("url", ["nonsense", "http://[bad", "ftp2://x/y", "http://127.0.0.1:1/x", "file:///none"])
def test_a_bad_address_is_one_row(url):
    (row,) = feeds.read_feed({"id": "f", "url": url}, wait=lambda s: None)
    assert row[0] == "f" and row[-1]


def test_broken_transfers_are_tried_again():
    import http.client

    calls = []

    def get(url):
        calls.append(url)
        raise http.client.IncompleteRead(b"")

    (row,) = feeds.read_feed({"id": "f", "url": "http://x"}, get=get, wait=lambda s: None)
    assert len(calls) == 2 and "IncompleteRead" in row[-1]


def test_envelope(spark):
    import json

    items = spark.createDataFrame([(1, 5, "a"), (2, None, 'b"'), (3, 9, None)], "ord long, pub long, title string")
    got = sinks.envelope(items, "2024-07-01", feeds=spark.createDataFrame([("f", 2)], "id string, n int"))
    doc = json.loads("".join(r["value"] for r in got.collect()))
    assert doc["count"] == 3 and [i["ord"] for i in doc["items"]] == [3, 1, 2] and doc["items"][0]["title"] is None and doc["feeds"] == [{"id": "f", "n": 2}]
    assert json.loads("".join(r["value"] for r in sinks.envelope(items.limit(0), "x").collect())) == {"generatedAt": "x", "count": 0, "items": []}


def test_feed_query(spark):
    q = FeedQuery.from_url("?q=a+-b&cat=x,zz&store=s&period=9y&sort=hot&lang=all", {"cat": {"x"}, "store": {"s"}})
    assert q.cat == {"x"} and q.deal and q.period == "all" and q.sort == "hot"
    assert FeedQuery.from_url(q.to_url()) == q and FeedQuery().to_url() == ""
    assert q.set_deal(False).store == frozenset() and q.pick("cat", "y").cat == {"y"} and q.pick("cat", "y").q == ""
    assert FeedQuery().toggle("store", "s").deal and FeedQuery().toggle("cat", "x").toggle("cat", "x") == FeedQuery()
    assert FeedQuery(q="a", mute=("m",), hide_read=True).reset() == FeedQuery(mute=("m",))
    schema = "ord long, source string, lang string, pub long, seen long, cats array<string>, plats array<string>, deal boolean, stores array<string>, works array<string>, originals int, is_read boolean, hay string"
    rows = [(1, "s", "ja", 100, 100, ["x"], [], True, ["s"], ["w"], 1, False, "a c"), (2, "s", "ja", None, 5, None, None, None, None, None, None, None, None), (3, "t", "en", 100, 100, ["x", "h"], [], True, ["s"], ["w"], 3, True, "a m"), (4, "t", "en", 100, 9, ["x"], [], True, ["s"], ["w"], 0, False, "a m")]
    x = spark.createDataFrame(rows, schema)
    p = FeedQuery(q="a -b", cat=frozenset("x"), deal=True, store=frozenset("s"), period="24h", lang="all", hidden_topics=frozenset("h"), mute=("M",))
    assert [r[0] for r in x.orderBy("ord").select(p.disposition(200)).collect()] == ["shown", "rejected", "hidden", "muted"]
    assert [r["ord"] for r in FeedQuery(lang="all", sort="hot", new=True).apply(x, 200, 50).collect()] == [3, 1]
    assert FeedQuery(lang="all", new=True).apply(x, 200, 0).count() == 0


def test_streaming_upsert_over_batches(spark, tmp_path):
    rng, state = random.Random(2), {}
    for b in range(4):
        rows = [(rng.randint(0, 9), b * 100 + i, f"t{b}.{i}", rng.choice([None, rng.randint(0, 60) * 86400]), b) for i in range(12)]
        for k, o, t, pub, _ in rows:
            old = state.get(k)
            state[k] = (o, t, old[2] if old and old[2] is not None else pub, old[3] if old else b)
        newest = max((v[2] for v in state.values() if v[2] is not None), default=0)
        state = {k: v for k, v in state.items() if v[2] is None or v[2] >= newest - archive.KEEP_SECONDS}
        spark.createDataFrame(rows, "k long, ord long, title string, pub long, batch int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = archive.run_upsert(spark.readStream.schema("k long, ord long, title string, pub long, batch int").parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
        assert {r["k"]: (r["ord"], r["title"], r["pub"], r["first_batch"]) for r in out.collect()} == state


def test_projection_or_what_was_there(spark, tmp_path):
    before = spark.createDataFrame([(0, "old")], "i long, t string")
    (tmp_path / "new.json").write_text('{"i": 1, "t": "new"}\n{"i": 2')
    got = lambda name: [tuple(r) for r in feeds.projection_or(spark, str(tmp_path / name), "i long, t string", before).collect()]
    assert got("new.json") == [(1, "new")] and got("none.json") == [(0, "old")]
    (tmp_path / "bad.json").write_text("<html>")
    assert got("bad.json") == [(0, "old")]


def test_rules_of_dates_are_made_once_and_copies_read_once(spark, monkeypatch):
    import pandas as pd

    from feedloom.functions import schedule as S

    made = []
    monkeypatch.setattr(S.ScheduleRules, "forms", lambda self, f=S.ScheduleRules.forms: made.append(1) or f(self))
    run = S.schedules("text", "pub")
    assert run is not None
    reader = S.Reader.of(S.RULES)
    assert len(made) == 1
    found = reader.read("3月4日発売 本日終了 2/3 launch")
    assert len(made) == 1
    for pub in (0, 200 * 86400, 400 * 86400 + 54_000):
        assert S.placed(found, pub, S.RULES) == announcements("3月4日発売 本日終了 2/3 launch", pub)
    rows = pd.DataFrame({"text": ["3月4日発売", "3月4日発売", None, ""], "pub": [0, 300 * 86400, 0, 0]})
    got = [[tuple(e) for e in r[0]] for r in spark.createDataFrame(rows).select(S.schedules("text", "pub")).collect()]
    assert got == [[("1970-03-04", "release")], [("1971-03-04", "release")], [], []]
