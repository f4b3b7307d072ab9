"""The item verdict case by case, with headlines of our own: keywords, exclusion, thresholds, names and keys, deals, off-topic, spoilers, tags, sources."""

import re
import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions import ruleset as R
from feedloom.functions import search
from feedloom.operators import pages

RULES = R.RuleSet(R.DEFAULT)


def ask(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return row.select(expr.alias("x")).first()["x"]


def judged(spark, rows, known=()):
    """(title, summary, kind, min_score) -> verdict rows by title's place."""
    df = spark.createDataFrame([(i, *r, "S1", "https://x.net/a", "ja") for i, r in enumerate(rows)], "ord long, title string, summary string, kind string, min_score int, source string, link string, lang string")
    keys = spark.createDataFrame([(k,) for k in known], "key string")
    return {r["ord"]: r for r in R.judged(df, RULES, keys).collect()}


@pytest.mark.parametrize(("text", "word", "want"), [("New film announced", "film", True), ("Filmmaker talks", "film", False), ("ＦＩＬＭ展", "film", True), ("film2", "film", False), ("film", "film", True), ("新しい映画だ", "映画", True), ("a b", "A  B", True), ("C++ film", "C++", True), ("x.film-y", "film", True)])
def test_keywords(spark, text, word, want):
    assert ask(spark, R.any_of(R.fold(F.col("t")), [word]), t=text) is want


def test_empty_lists_hold_for_nothing(spark):
    assert ask(spark, R.any_of(F.col("t"), []) | R.matches(F.col("t"), []), t="a") is False


def test_fold(spark):
    assert ask(spark, R.fold(F.col("t")), t="　ＰＳ５！　\t\n a b ～") == "PS5! a b ~"
    assert ask(spark, R.fold(F.lit(None).cast("string")), t="x") == ""


def test_verdicts(spark):
    got = judged(spark, [
        ("［ＡＤ］ new film in cinema", "", "specialist", None), ("cinema", "buy a lottery ticket", "specialist", None), ("Filmmaking, 2 recipes", "", "general", None),
        ("A film in the cinema", "", "general", None), ("cinema", "", "general", None), ("cinema", "", "press", None), ("cinema", "", "press", 4), ("nothing", "", "specialist", None),
        ("『Hero 4』グッズ通販", "", "aggregator", None), ("『Ｈｅｒｏ　４』グッズ通販", "", "aggregator", None), ("Film - Daily Screen", "", "unknown", None), ("review", "a recipe for film", "specialist", None),
    ], ["hero4"])
    assert sorted(got) == [3, 4, 6, 7, 8, 9, 10, 11]
    assert got[3]["score"] == 10 and got[3]["hits"] == ["film", "cinema"] and got[8]["score"] == 4 and got[8]["hits"] == ["#known-work"] and got[9]["works"] == ["Hero 4"]
    assert got[10]["match_title"] == "Film" and got[11]["score"] == 0 and got[11]["hits"] == ["film", "recipe", "review"]


def test_publisher_and_source(spark):
    title, name = R.publisher_of(F.col("t"))
    assert ask(spark, F.struct(title, name), t="『X』上映 - Screen.com") == ("『X』上映", "Screen.com")
    assert ask(spark, F.struct(title, name), t="A - B - C\n") == ("A - B", "C")
    assert ask(spark, F.struct(title, name), t="no-dash here") == ("no-dash here", None)
    assert ask(spark, R.unsourced(F.col("t")), t="上映決定（Wire） ") == "上映決定"
    assert ask(spark, RULES.syndicated(F.col("s"), F.col("l")), s="Ｐｏｒｔａｌ News", l="x") is True
    assert ask(spark, RULES.syndicated(F.col("s"), F.col("l")), s="a", l="https://m.example.org/1") is True
    assert ask(spark, RULES.syndicated(F.col("s"), F.col("l")), s="a", l="https://badexample.org/1") is False


@pytest.mark.parametrize(("title", "want"), [
    ("劇場版『Moon』新PV公開", ["Moon"]), ("『Moon 2』新キャラ「オル」の情報", ["Moon 2"]), ("新しい映画「Sun」上映、作品 「Star」も", ["Sun", "Star"]), ("'Blue Sky' opens", ["Blue Sky"]), ("It's 'Blue'", []),
    ("『新作Moon』『Moon』『M』『未定』", ["Moon"]), ("『映画X』", ["映画X"]), ("『Moon (film)』", ["Moon"]), (None, []),
])
def test_names(spark, title, want):
    assert ask(spark, RULES.works(F.col("t")), t=title) == want


def test_name_keys(spark):
    key = lambda t: ask(spark, RULES.work_key(F.col("t")), t=t)
    assert len({key(t) for t in ("SSX/X-2 HD", "Star Saga X/X-2 HD", "SS X/X-2 ＨＤ", "スターサーガX/X-2HD")}) == 1
    assert key("スターサーガVII Part II") == key("SS7 part2") and key("月の野望･飛") == key("月の野望・飛")
    assert key("SSX-2") != key("SS10") and key("SS14") != key("SS7") and key("SSXIVz") == "ssxivz"


def test_shown_names(spark):
    items = spark.createDataFrame([(1, ["SS X", "SSX"]), (2, ["SSX"]), (3, ["Star Saga X"]), (4, ["Sun"]), (5, []), (6, ["Sun", "SS X", "SSX"])], "ord long, works array<string>")
    got = {r["ord"]: r["works"] for r in pages.with_display_names(items, RULES).collect()}
    assert got == {1: ["SSX"], 2: ["SSX"], 3: ["SSX"], 4: ["Sun"], 5: [], 6: ["Sun", "SSX"]}


@pytest.mark.parametrize(("title", "summary", "want"), [
    ("【最安】『Moon』が“70％オフ”の「7678円→2303円」。Alpha Storeにて", "", (["alpha"], 70, False)), ("『Moon』がベータにて無料配布中", "", (["beta"], None, True)), ("Moonがセール", "at the Beta shop", (["beta"], None, False)),
    ("30%オフの690円で販売中", "", ([], 30, False)), ("【4,500円→0円】『Moon』無料配布", "", ([], None, True)), ("110% off, 20 % off, 5%オフ", "", ([], 20, False)), ("0% off", "", ([], None, False)),
    ("全巻50%還元セール", "", None), ("Console sale: 50% off", "", None), ("『Moon』上映", "50% off", None),
])
def test_deals(spark, title, summary, want):
    got = ask(spark, RULES.deal(R.fold(F.col("t")), R.fold(F.col("s"))), t=title, s=summary)
    assert (got and (got["stores"], got["off"], got["free"])) == want


@pytest.mark.parametrize(("title", "want"), [("Stage play of Moon", True), ("stage play of Moon", False), ("舞台『Star Saga』開幕", False), ("舞台の映画", False), ("Stage play cinema stock price", True)])
def test_off_topic(spark, title, want):
    assert ask(spark, RULES.off_topic(R.fold(F.col("t")), RULES.score(R.fold(F.col("t")), F.lit(""))[0]), t=title) is want


@pytest.mark.parametrize(("title", "want"), [("Spoilers ahead", True), ("spoiler-free: spoilers ahead", False), ("予告、結末", False), ("本当の結末", True), ("第3話の感想", True), ("第3話", False), ("感想", False)])
def test_spoilers(spark, title, want):
    assert ask(spark, RULES.spoiler(R.fold(F.col("t"))), t=title) is want


def test_tags(spark):
    tags = lambda t, s="": ask(spark, RULES.categories(R.fold(F.col("t")), R.fold(F.col("s"))), t=t, s=s)
    assert tags("『Moon』公開日が決定") == ["release"] and tags("x", "lawsuit, festival") == ["event"] and tags("A lawsuit festival") == ["event", "trouble"]
    assert tags("『訴訟だらけ』予告") == [] and tags("続編未定") == [] and tags("続編未定だが続編") == ["sequel"] and tags("セール") == []
    plats = lambda t: ask(spark, RULES.platforms(R.fold(F.col("t")), F.lit("")), t=t)
    assert plats("『X』 on Stream 2") == ["stream2"] and plats("Stream 2 / Stream / DVD") == ["stream2", "stream", "disc"] and plats("home theatre") == []


def test_sale_follows_the_deal(spark):
    got = judged(spark, [("『X』が70％オフのセール、上映会", "", "specialist", None), ("上映会", "", "specialist", None)])
    assert got[0]["cats"] == ["event", "sale"] and got[1]["cats"] == ["event"]
    label = lambda *d: spark.createDataFrame([(d,)], "deal struct<stores:array<string>,off:int,free:boolean>").select(R.deal_label(F.col("deal")).alias("l")).first()["l"]
    assert (label([], 70, False), label([], 70, True), label([], None, False)) == ("-70%", "Free", "Sale")


def test_configuration_is_read(tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(R.DEFAULT, ensure_ascii=False), encoding="utf-8")
    assert R.RuleSet.read(str(tmp_path / "rules.json")) == RULES
    assert R.java("a$") == r"a\z" and R.java(r"a\$") == r"a\$" and R.java("(?:a$|b)") == "(?:a$|b)"


def test_addresses_of_pages(spark):
    many = lambda name, n: [(name,)] * n
    names = many("a b", 9) + many("a-b-2", 8) + many("A/b", 7) + many("a!b", 6) + many("a　b", 5) + many("！", 4) + many("ｗｏｒｋ", 3) + many("once", 1)
    items = spark.createDataFrame(names, "w string").select(F.array("w").alias("works"))
    got = {r["name"]: (r["place"], r["slug"]) for r in pages.work_pages(items).collect()}
    assert got == {"a b": (1, "a-b"), "a-b-2": (2, "a-b-2"), "A/b": (3, "A-b"), "a!b": (4, "a-b-3"), "a　b": (5, "a-b-4"), "！": (6, "work"), "ｗｏｒｋ": (7, "work-2")}


def test_search_forms(spark):
    assert search.normal("ＡｂＣ ひらがなゔ ｶﾞ ㍿") == "abc ヒラガナヴ ガ 株式会社"
    assert ask(spark, search.searchable(F.col("t")), t="ＡｂＣ ひらがなゔ ｶﾞ ㍿") == "abc ヒラガナヴ ガ 株式会社"
    assert search.last_word("a  ぜる・だ ") == "ゼルダ" and search.last_word("a -b") is None and search.last_word(" ") is None


def test_names_grow_with_the_prefixes_in_proportion(spark):
    from pyspark.sql import functions as F

    from feedloom.functions import ruleset as R

    prefixes = ["新作", "劇場版", "映画", "a", "b+", "c"]
    rules = R.RuleSet(R.DEFAULT | {"works": R.DEFAULT["works"] | {"stripPrefixes": prefixes}})
    assert str(rules.canonical(F.col("w"))).count("translate") <= 2
    names = ["新作　 x y", "新作x", "新作  x", "映画劇場版 新作Q2", "a b+ c dd", "ab", "ａ﻿bc", "", " 　 ", "a\t    b  c ", "c\U0001f600\U0001f600"]
    got = {r["w"]: r["c"] for r in spark.createDataFrame([(n,) for n in names], "w string").select("w", rules.canonical(F.col("w")).alias("c")).collect()}
    blank = lambda s: re.sub("[\\s  　﻿]+", " ", s.translate(str.maketrans(R.FULL, R.HALF))).strip(" ")

    def plain(w):
        w = blank(w)
        for p in prefixes:
            if w.startswith(p) and len(w) > len(p) + 1:
                w = w[len(p) :].strip()
        return re.sub(r"\s*\(film\)$", "", w)

    assert got == {n: plain(n) for n in names}


def test_pages_announce_one_year_however_many_headlines(spark, tmp_path):
    import pandas as pd

    from feedloom import catalogue

    keys = [24 * k for k in (0, 1, 2, 3, 900, 901, 5000, 5001, 9000)]
    pd.DataFrame({"p_partkey": keys, "p_name": "red gear", "p_brand": "Brand#1", "p_type": "t", "p_size": pd.array([1] * len(keys), "int32"), "p_retailprice": 1.0}).to_parquet(tmp_path / "part.parquet")
    got = catalogue.QUERIES["calendar_of_pages"](spark, str(tmp_path)).collect()
    assert [(r["subject"], r["date"], r["verb"]) for r in got] == [("red gear", "1970-12-10", "open")]
