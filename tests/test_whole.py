"""Queries do the whole job: held against plain Python over the tables, not against SQL made from the same plan."""

import duckdb
import pandas as pd
import pytest

from feedloom import catalogue as C
from feedloom.functions import rules as R
from feedloom.functions.rules import RULES
from feedloom.plans import jobs
from feedloom.plans.dialect import Duck, Spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def late(tmp_path_factory):
    """Documents whose words of interest come late: in a first line of over 80 characters, or after 220."""
    path = tmp_path_factory.mktemp("late")
    texts = ["Zzz " * 60 + "Latecomer\n" + "zzz " * 100 + "license scum", "Zzz " * 60 + "Latecomer\nzzz", "short\nzzz the end"]
    pd.DataFrame({"doc_id": [0, 1, 2], "text": texts, "lang": "en", "source": ["src0", "src1", "src2"], "n_chars": [len(t) for t in texts]}).to_parquet(path / "documents.parquet")
    return str(path)


def ask(spark, sf_dir, name):
    return C.QUERIES[name](spark, sf_dir).toPandas()


def test_items_read_whole_texts(spark, late):
    flags = ask(spark, late, "keyword_flags").set_index("ord")
    assert flags["f2"].to_dict() == {0: True, 1: False, 2: False}
    assert ask(spark, late, "hard_exclude").set_index("ord")["excluded"].to_dict() == {0: True, 1: False, 2: False}
    assert {(r.tag, r.n) for r in ask(spark, late, "multilabel_tags_exploded").itertuples()} == {("law", 1)}
    pages = ask(spark, late, "entity_pages_min2").set_index("w")["n"].to_dict()
    assert pages == {"Zzz": 2, "Latecomer": 2}
    titles = ask(spark, late, "wire_projection").set_index("i")["t"]
    assert titles[1] == "Zzz " * 60 + "Latecomer" and titles[2] == "short"


def test_day_runs_holds_every_day(spark):
    events = pd.read_parquet(f"{SF}/events.parquet")
    events["t"] = events["ts"].astype("datetime64[s]").astype("int64")
    events["day"] = events["t"] // 86400
    want = events.assign(newest=-events["day"]).sort_values(["newest", "t", "event_id"])
    header = want["day"].ne(want["day"].shift())
    got = ask(spark, SF, "day_runs").sort_values("place")
    assert got["place"].tolist() == list(range(1, len(events) + 1))
    assert got["event_id"].tolist() == want["event_id"].tolist() and got["day"].tolist() == want["day"].tolist()
    assert got["header"].tolist() == header.tolist() and got["header"].sum() == events["day"].nunique() > 2


def test_cut_off_titles_are_found_by_their_brackets(spark, tmp_path):
    whole = "Alpha beta gamma delta epsilon zeta eta theta (iota kappa lambda) and much more of it"
    texts = [whole, whole[:60], "Completely other words that nothing else here begins with at all", "Some words) of a headline, closed without being opened, go on here"]
    pd.DataFrame({"doc_id": [5, 6, 10, 11], "text": texts, "lang": "en", "source": "src1", "n_chars": [len(t) for t in texts]}).to_parquet(tmp_path / "documents.parquet")
    # 6 is cut off inside its bracket and linked uncut; the others link by their copies, to themselves if to no earlier title
    assert {(r.ord, r.full_ord) for r in ask(spark, str(tmp_path), "prefix_link_first").itertuples()} == {(5, 5), (6, 5), (10, 10), (11, 11)}
    flagged = jobs._items(spark, str(tmp_path)).toPandas().set_index("ord")["truncated"].to_dict()
    assert flagged == {5: False, 6: True, 10: False, 11: False}
    cid = ask(spark, str(tmp_path), "cluster_replay").set_index("ord")["cid"].to_dict()
    assert cid == {5: 5, 6: 5, 10: 10, 11: 11}


def test_limits_are_those_of_the_reference(spark, tmp_path):
    n = 6_050
    pd.DataFrame({"doc_id": range(n), "text": "with licenses", "lang": "en", "source": ["src4" if i < 101 else f"src{4 * (i % 500 + 2)}" for i in range(n)], "n_chars": 13}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"event_id": range(4_001), "user_id": 7, "event_type": "click", "ts": pd.date_range("2024-01-01", periods=4_001, freq="s").astype("datetime64[us]"), "value": 0.0}).to_parquet(tmp_path / "events.parquet")
    assert len(ask(spark, str(tmp_path), "score_threshold_topk")) == 6_000
    assert (ask(spark, str(tmp_path), "per_feed_limit").groupby("source")["k"].max()["src4"]) == 100
    assert sorted(ask(spark, str(tmp_path), "read_set_latest")["event_id"]) == list(range(1, 4_001))


def test_visits_do_not_meet_the_items_they_count(spark, tmp_path):
    """New items of a visit are a difference of two counts: no row for each pair of a visit and an item of its days."""
    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:01", "2024-01-01 01:00:00", "2024-01-01 05:00:00", "2024-01-03 00:00:00", "2024-01-03 00:00:00"]).astype("datetime64[us]")
    kinds = ["view", "signup", "signup", "view", "view", "signup", "view"]
    pd.DataFrame({"event_id": range(7), "user_id": [1, 2, 2, 2, 1, 2, 1], "event_type": kinds, "ts": at, "value": 0.0}).to_parquet(tmp_path / "events.parquet")
    x = C.QUERIES["session_news"](spark, str(tmp_path))
    assert {(r["user_id"], r["visit"]): r["n_new"] for r in x.collect()} == {(1, 1): 0, (1, 2): 2, (1, 3): 1, (2, 1): 0, (2, 2): 1}
    assert "Generate" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_link_first_reads_texts_once(spark):
    """Titles and their compared forms are kept, so that the links rest on no scan of the documents."""
    x = C.QUERIES["prefix_link_first"](spark, SF)
    assert not [f for f in x.inputFiles() if "documents" in f]
    assert x.count() > 0


def test_words_are_sought_in_texts_lowered_once(spark):
    """A list of words lowers no text of the items anew, and finds words as the SQL's pattern does."""
    s, d = Spark(), Duck()
    assert "lower(" not in R.any_of(s, "whole", ("in", "from")) + R.score(s, RULES, "title", "summary")
    texts = ["within", "With", "x WITH-", "9with", "with9", "éwith", "with\n", "as with", "withwith with", "a from_in", "infrom", "", "c+ +", "the the the", "in"]
    one = lambda dialect: [R.keyword(dialect, "t", "with"), R.keyword(dialect, "t", "c+"), R.keyword(dialect, "t", "the the"), R.any_of(dialect, "t", ("in", "from", "with")), dialect.each_in("replace(t, 'the the', '')", lambda e: R.any_of(dialect, e, ("the", "in")))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", *(f"{e} AS c{i}" for i, e in enumerate(one(s)))).toPandas()
    frame = pd.DataFrame({"t": texts})  # noqa: F841
    want = duckdb.sql(f"SELECT t, {', '.join(f'{e} AS c{i}' for i, e in enumerate(one(d)))} FROM frame").df()
    assert got.sort_values("t").values.tolist() == want.sort_values("t").values.tolist()
