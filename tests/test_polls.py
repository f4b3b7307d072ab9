"""Polls of live feeds over restarts, and sets of documents that are replaced as a whole."""

import functools
import http.server
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.plans import jobs
from feedloom.sources import feeds, sinks
from feedloom.streaming import polls


def rss(*numbers):
    items = "".join(f"<item><title>t{n}</title><link>https://e.org/{n}</link></item>" for n in numbers)
    return f"<rss><channel>{items}</channel></rss>".encode()


@pytest.fixture
def server():
    """A server whose documents the test changes; what is None fails."""
    shown: dict[str, bytes | None] = {}

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            data = shown.get(self.path) or b"<broken"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield shown, f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_no_entry_is_lost_or_twice_over_restarts(spark, tmp_path, server):
    shown, at = server
    registry = [{"id": "a", "url": f"{at}/a", "limited": True}, {"id": "b", "url": f"{at}/b"}, {"id": "c", "url": f"{at}/gone", "fallbacks": [{"via": "relay", "url": f"{at}/c"}]}]
    folder = str(tmp_path / "feeds")
    scan = functools.partial(feeds.scan, spark, registry)
    got = lambda: sorted((r["feed"], int(r["link"].rsplit("/", 1)[-1]), r["poll"]) for r in polls.entries(spark, folder).collect())
    polls.pass_on(spark, folder)  # nothing yet

    shown |= {"/a": rss(2, 1, 2), "/b": rss(1), "/c": rss(9)}
    polls.hourly(spark, scan(), folder, 1)
    want = [("a", 1, 0), ("a", 2, 0), ("b", 1, 0), ("c", 9, 0)]
    assert got() == want

    shown |= {"/a": rss(3, 2), "/b": None}
    polls.write_poll(scan(), folder, 3600)  # broken off before anything was passed on
    shown |= {"/a": rss(5, 4, 1), "/b": rss(2, 1)}
    polls.hourly(spark, scan(), folder, 7200)
    want = sorted([*want, ("a", 3, 1), ("a", 4, 2), ("a", 5, 2), ("b", 2, 2)])
    assert got() == want

    commits = sorted((tmp_path / "feeds/log/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # the last micro-batch was written, but its end was not noted
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    polls.pass_on(spark, folder)
    assert got() == want
    polls.hourly(spark, scan(), folder, 10800)
    assert got() == want
    (bad,) = polls.failures(spark, folder).collect()
    assert (bad["feed"], bad["first_poll"], bad["last_poll"], bad["n"]) == ("b", 1, 1, 1) and "ParseError" in bad["error"]


def test_keys_go_after_their_time_and_nulls_are_a_feed(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(f, None, i, t, link, None, None, None, None) for i, (f, t, link) in enumerate(x)], feeds.SCHEMA)
    folder, day = str(tmp_path / "f"), 86400
    polls.hourly(spark, rows((None, "x", "u"), ("f", "x", "u"), (None, "y", "u")), folder, 1)
    polls.hourly(spark, rows(("f", "z", "u")), folder, 29 * day)
    out = polls.hourly(spark, rows(), folder, 30 * day)
    assert sorted((r["feed"] or "", r["title"], r["poll"]) for r in out.collect()) == [("", "x", 0), ("f", "x", 0)]
    polls.hourly(spark, rows(("f", "later", "v")), folder, 61 * day)
    out = polls.hourly(spark, rows(("f", "again", "u")), folder, 62 * day)
    assert [r["poll"] for r in out.where("feed = 'f' AND link = 'u'").orderBy("poll").collect()] == [0, 4]


def test_documents_are_whole_or_as_before(spark, tmp_path):
    path = str(tmp_path / "site")
    read = lambda: {r["feed"]: r["xml"] for r in sinks.documents(spark, path).collect()}
    assert read() == {}
    sets = [{"01": "<a>\n1</a>", "a b/c": "<b/>", None: "n"}, {"01": "<a>2</a>"}, {"02": "<c/>"}]
    frames = [spark.createDataFrame(list(s.items()), "feed string, xml string") for s in sets]
    first = sinks.write_documents(frames[0], path)
    assert read() == sets[0]
    bad = frames[1].unionByName(spark.createDataFrame([("x", "y")], "feed string, xml string")).withColumn("xml", F.when(F.col("feed") == "x", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("xml")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_documents(bad, path)
    assert read() == sets[0] and feeds.versions(spark, path) == [f"file:{first}"]
    for s, f in zip(sets[1:], frames[1:]):
        sinks.write_documents(f, path)
        assert read() == s
    assert len(feeds.versions(spark, path)) == 2


def test_polls_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = jobs.stream_feed_polls(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(jobs.POLLS_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
