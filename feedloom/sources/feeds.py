"""Feed documents as rows: a data source that fetches a registry of feeds, and a reader of stored feed files.

The source takes the option `registry`, a JSON list of {id, url, fallbacks?, limited?}. Feeds of a limited host share one
partition and are read one after another with a pause; each other feed is a partition of its own. A feed that can't be read gives
one row with its error and no entry, so that the others are kept. Entries without a title or http(s) link are left out.
"""

from __future__ import annotations

import datetime
import email.utils
import http.client
import json
import re
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "title string, link string, pub long, summary string, image string"
SCHEMA = f"feed string, via string, place int, {ENTRY}, error string"
# Time limits, retries and pauses in seconds.
SOFT_SECONDS, HARD_SECONDS, RETRIES, PAUSE, PAUSE_BUSY, GAP = 30, 45, 1, 2, 30, 1.5
BUSY = (429, 503)
#: What a bad address, a broken transfer or an unreadable document can raise; anything else is an error of this program.
FAILURES = (OSError, http.client.HTTPException, ET.ParseError, ValueError, LookupError)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def seconds(text: str | None) -> int | None:
    """Mail or ISO 8601 dates; what is neither is null, and the entry stays."""
    for read in (email.utils.parsedate_to_datetime, lambda t: datetime.datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            at = read((text or "").strip())
        except (ValueError, TypeError):
            continue
        return int((at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp())
    return None


def image(entry: ET.Element, summary: str) -> str | None:
    """The first https picture that is no tracker: enclosure, media content, thumbnail, then the text's own."""
    offers: list[tuple[int, str]] = []
    for e in entry.iter():
        kind, url = e.get("type") or e.get("medium") or "", e.get("url") or ""
        match local(e.tag):
            case "enclosure" if kind.startswith("image"):
                offers.append((0, url))
            case "content" if url and (not kind or kind.startswith("image")):
                offers.append((1, url))
            case "thumbnail":
                offers.append((2, url))
    offers += [(3, u) for u in re.findall(r"<img[^>]+src=[\"']([^\"']+)", summary)]
    return next((u for _, u in sorted(offers, key=lambda o: o[0]) if u.startswith("https://") and not re.search("pixel|track|beacon", u)), None)


def entries(data: bytes) -> Iterator[tuple]:
    """Entries of an RSS 2.0, RSS 1.0 or Atom document, in its order."""
    for e in ET.fromstring(data).iter():
        if local(e.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for c in e:
            name = local(c.tag)
            value = "".join(c.itertext()).strip() or (c.get("href", "") if name == "link" and c.get("rel", "alternate") == "alternate" else "")
            if value:
                got.setdefault(name, value)
        title, link = got.get("title", ""), got.get("link", "")
        if title and re.match("https?://", link):
            summary = got.get("description") or got.get("summary") or got.get("encoded") or ""
            when = next((got[k] for k in ("pubdate", "date", "published", "updated") if k in got), None)
            yield title, link, seconds(when), summary, image(e, summary)


def fetch(url: str, soft: float = SOFT_SECONDS, hard: float = HARD_SECONDS) -> bytes:
    """The whole body; `soft` bounds each wait on the connection, `hard` the transfer."""
    end, out = time.monotonic() + hard, []
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "feedloom"}), timeout=soft) as r:
        while part := r.read(1 << 16):
            out.append(part)
            if time.monotonic() > end:
                raise TimeoutError(f"{url}: no end after {hard} s")
    return b"".join(out)


def fetch_again(url: str, get=fetch, wait=time.sleep) -> bytes:
    for left in range(RETRIES, -1, -1):
        try:
            return get(url)
        except (OSError, http.client.HTTPException) as e:
            if not left:
                raise
            wait(PAUSE_BUSY if isinstance(e, urllib.error.HTTPError) and e.code in BUSY else PAUSE)
    raise AssertionError


def read_feed(feed: dict, get=fetch, wait=time.sleep) -> Iterator[tuple]:
    """The first address that gives a readable document; `via` is null for the feed's own, else the fallback's name."""
    error = None
    for via, url in [(None, feed["url"]), *((f["via"], f["url"]) for f in feed.get("fallbacks", ()))]:
        try:
            rows = list(entries(fetch_again(url, get, wait)))
        except FAILURES as e:
            error = f"{type(e).__name__}: {e}"
            continue
        yield from ((feed["id"], via, i, *row, None) for i, row in enumerate(rows))
        return
    yield (feed["id"], None, None, None, None, None, None, None, error)


class Feeds(InputPartition):
    def __init__(self, feeds: list[dict]):
        self.feeds = feeds


class FeedReader(DataSourceReader):
    def __init__(self, registry: list[dict]):
        self.registry = registry

    def partitions(self):
        limited = [f for f in self.registry if f.get("limited")]
        return [Feeds([f]) for f in self.registry if not f.get("limited")] + ([Feeds(limited)] if limited else [])

    def read(self, partition):
        for i, feed in enumerate(partition.feeds):
            if i:
                time.sleep(GAP)
            yield from read_feed(feed)


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "feeds"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FeedReader(json.loads(self.options["registry"]))


def scan(spark: SparkSession, registry: list[dict]) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.read.format("feeds").option("registry", json.dumps(registry)).load()


def stored_feeds(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Entries of all feed files below a folder, one file at a time; an unreadable file gives one row with its error."""

    def run(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                try:
                    rows = [(name, None, i, *row, None) for i, row in enumerate(entries(data))]
                except FAILURES as e:
                    rows = [(name, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["feed", "via", "place", "title", "link", "pub", "summary", "image", "error"]).astype({"pub": "Int64", "place": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def all_versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Number -> folder of every version at `path`, whole or not."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
    return {int(p.getName().removeprefix("version=")): p.toString() for p in found if p.getName().startswith("version=")}


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of an archive, newest first."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    return [p for _, p in sorted(all_versions(spark, path).items(), reverse=True) if P(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(P(p, "_SUCCESS"))]


def stored_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of an archive that can be read; no rows if there is none yet."""
    for p in versions(spark, path):
        try:
            spark.read.parquet(p).limit(1).collect()
        except (PySparkException, Py4JJavaError):
            continue
        return spark.read.schema(schema).parquet(p)
    return spark.createDataFrame([], schema)


def projection_or(spark: SparkSession, path: str, schema: str, stands_in: DataFrame) -> DataFrame:
    """The published projection (JSON lines) as it is now; what was there before, if that can't be read or holds nothing that fits."""
    try:
        now = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        return stands_in if now.isEmpty() else now
    except (PySparkException, Py4JJavaError):
        return stands_in
