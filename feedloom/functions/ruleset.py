"""The item verdict: rules read from a JSON configuration, each compiled to built-in column expressions.

A configuration has the blocks of DEFAULT below. Its key names are fixed values, so that existing configurations can be read; the
words and patterns in DEFAULT are this project's own and fit its test tables. Patterns are Java's; a final $ means the end of the
text, as it does where such files come from. Lengths are in code points. All texts are folded before they are compared: full-width
ASCII to ASCII, runs of white space to one blank. Nulls: a null title or summary is an empty one, a null minScore is not given.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of a configuration, with rules of our own.
DEFAULT = {
    "thresholds": {"specialist": 0, "general": 3, "aggregator": 4, "press": 6},
    "hardExclude": {"title": ["[ad]", "求人"], "any": ["lottery ticket", "宝くじ"]},
    "relevance": {"weights": {"film": 3, "cinema": 2, "映画": 3, "premiere": 2, "監督": 1, "stock price": -4, "株価": -4, "recipe": -3, "review": 0}, "knownWorkBonus": 4},
    "platforms": {
        "list": [
            {"id": "theatre", "label": "Theatre", "keywords": ["theatre", "劇場"], "exclude": ["home theatre"]},
            {"id": "stream2", "label": "Stream 2", "keywords": ["Stream 2"]},
            {"id": "stream", "label": "Stream", "keywords": ["Stream"], "exclude": ["Stream 2"]},
            {"id": "disc", "label": "Disc", "keywords": ["Blu-ray", "DVD", "円盤"]},
        ]
    },
    "categories": [
        {"id": "release", "label": "Releases", "keywords": ["release date", "公開日"]},
        {"id": "event", "label": "Events", "keywords": ["festival", "上映会"]},
        {"id": "trouble", "label": "Trouble", "keywords": ["lawsuit", "訴訟"], "scope": "title", "skipQuoted": True, "sensitive": True},
        {"id": "sequel", "label": "Sequels", "keywords": ["sequel", "続編"], "ignore": ["続編未定"]},
        {"id": "sale", "label": "Sales", "keywords": []},
    ],
    "spoiler": {"never": ["spoiler[- ]free", "ネタバレなし"], "explicit": ["spoilers? ahead", "ネタバレ注意"], "safe": ["trailer", "予告"], "strong": ["ending explained", "結末"], "episode": [r"episode \d+", r"第\d+話"], "reaction": ["reactions?", "感想"]},
    "works": {"stripPrefixes": ["新作", "劇場版", "映画"], "stripSuffixPatterns": [r"\s*\(film\)$"], "cornerQuoteContextPattern": r"(?:映画|作品|film)\s*$", "ignore": ["未定"], "aliases": {"スターサーガ": "SS", "Star Saga": "SS"}, "numeralPrefixes": ["SS", "part"], "lenientCornerQuotes": True},
    "syndication": {"windowHours": 72, "similarity": 0.7, "portals": ["Portal News", "まとめ"], "hosts": ["example.org", "portal.example.com"]},
    "deals": {"signals": [r"\d+\s*%\s*(?:off|オフ)", "セール", "無料配布"], "exclude": ["還元", "console"], "stores": [{"id": "alpha", "label": "Alpha", "pattern": "alpha ?store"}, {"id": "beta", "label": "Beta", "pattern": "beta|ベータ"}], "units": ["オフ", "off", "割引"], "free": ["無料配布", "free to keep", r"(?<![0-9,])0円で"]},
    "offTopic": {"signals": ["舞台", "Stage play"], "gameOriginWorks": ["Star Saga", "スターサーガ"]},
}

#: Fixed value: what counts as white space.
BLANK = "[\\s" + "\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff" + "]"
#: Runs of white space but for single blanks.
RUN = f"[{BLANK}&&[^ ]]{BLANK}*| {BLANK}+"
FULL, HALF = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
ASCII_WORD = re.compile(r"[A-Za-z][A-Za-z0-9 .+-]*")
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi")
# The marks and blanks that compared titles and keys of names leave out, the brackets that a whole title closes, the
# quotes around names with the lengths of names, and the characters that speak against a name.
MARKS = "[ \\t\\n\\r\\x{a0}\\x{3000}「」『』【】\\[\\]（）()、。！？!?・:：\\-—―~〜\"'“”‘’…]+"
KEY_MARKS = "・･:：~〜～™®"
BRACKETS = ("『』", "「」", "【】", "（）", "《》", "〈〉")
LEADING_BRACKET = r"^[【\[][^】\]]*[】\]]"
PHOTO = r"^(?:Photo|写真)\s*[|｜]\s*"
IN_DOUBLE_QUOTES, AT_START = "『([^』]{1,60})』", "^'([^']{2,60})'"
IN_CORNER_QUOTES, SHORT_IN_CORNER_QUOTES, NO_NAME = "「[^」]{1,40}」", "「[^」%s]{1,25}」", "。、！？!?…"
DISCOUNT = r"(?i)([0-9]{1,3})\s*%%\s*(?:%s)"


def java(pattern: str) -> str:
    return re.sub(r"(?<!\\)\$(?=\Z|\))", r"\\z", pattern)


def folded(text: str) -> str:
    return re.sub(r"\s+", " ", text.translate(str.maketrans(FULL, HALF))).strip()


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def fold(c: Column) -> Column:
    """Characters are translated only where there are any to translate; behind the runs all white space is single blanks."""
    text = F.coalesce(c, F.lit(""))
    wide = F.rlike(text, F.lit(f"[{FULL[0]}-{FULL[-1]}]"))
    return F.trim(F.regexp_replace(F.when(wide, F.translate(text, FULL, HALF)).otherwise(text), RUN, " "))


def either(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def matches(c: Column, patterns, flags: str = "(?i)") -> Column:
    """Any of the patterns, in one scan; none if there are none."""
    return F.rlike(c, F.lit(flags + "(?:" + "|".join(map(java, patterns)) + ")")) if patterns else F.lit(False)


def any_of(c: Column, words) -> Column:
    """Any keyword in a folded text: ASCII words between other characters than letters and digits, others anywhere; case never matters."""
    words = [folded(w) for w in words]
    plain = [re.escape(w) for w in words if ASCII_WORD.fullmatch(w)]
    parts = [F.contains(F.lower(c), F.lit(w.lower())) for w in words if not ASCII_WORD.fullmatch(w)]
    if plain:
        parts.append(F.rlike(c, F.lit(rf"(?i)(?:^|[^A-Za-z0-9])(?:{'|'.join(plain)})(?:\z|[^A-Za-z0-9])")))
    return either(parts)


def without(c: Column, words) -> Column:
    return reduce(lambda x, w: F.replace(x, F.lit(folded(w)), F.lit(" ")), words, c)


def labels(pairs: list[tuple[str, Column]]) -> Column:
    """The labels whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(ok, F.lit(k)) for k, ok in pairs))) if pairs else F.array().cast("array<string>")


# Fixed values in the next two patterns: a publisher of up to 40 characters behind a dash, a source of up to 30 in a bracket at the end.
def publisher_of(title: Column) -> tuple[Column, Column]:
    """("title - publisher": the title, the publisher or null)."""
    p = rf"(?s)^(.*[^{BLANK[1:]}){BLANK}+-{BLANK}+([^-]{{1,40}})\z"
    has = F.contains(title, F.lit("-")) & F.rlike(title, F.lit(p))
    return F.when(has, F.regexp_extract(title, p, 1)).otherwise(title), F.when(has, trimmed(F.regexp_extract(title, p, 2)))


def unsourced(title: Column) -> Column:
    """Without one bracket of up to 30 characters at the end."""
    return trimmed(F.regexp_replace(title, rf"[（(][^（）()]{{1,30}}[）)]{BLANK}*\z", ""))


def compared(title: Column) -> Column:
    """What equal news have in common: the folded title without publisher, source, a bracket at the start, marks and blanks, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(fold(unsourced(publisher_of(F.coalesce(title, F.lit("")))[0])), LEADING_BRACKET, ""), MARKS, ""))


def truncated(title: Column) -> Column:
    """The title was cut off: it opens more brackets of a kind than it closes."""
    n = lambda mark: F.regexp_count(F.coalesce(title, F.lit("")), F.lit(mark))
    return either([n(a) > n(b) for a, b in BRACKETS])


@dataclass(frozen=True)
class RuleSet:
    config: dict

    @classmethod
    def read(cls, path: str) -> RuleSet:
        """Rules of a JSON file that the driver can open."""
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def hard_excluded(self, t: Column, s: Column) -> Column:
        c = self.config["hardExclude"]
        return either([F.contains(F.upper(t), F.lit(folded(w).upper())) for w in c["title"]]) | any_of(F.concat(t, F.lit(" "), s), c["any"])

    def score(self, t: Column, s: Column) -> tuple[Column, Column]:
        """(sum of weights, keywords met). In the title a positive weight counts twice; the summary counts only without the title."""
        total, hits = F.lit(0), []
        for word, weight in self.config["relevance"]["weights"].items():
            total = total + F.when(any_of(t, [word]), 2 * weight if weight > 0 else weight).when(any_of(s, [word]), weight).otherwise(0)
            hits.append((word, any_of(t, [word]) | any_of(s, [word])))
        return total, labels(hits)

    def threshold(self, kind: Column, min_score: Column) -> Column:
        c = self.config["thresholds"]
        return F.coalesce(min_score, *(F.when(kind == k, F.lit(v)) for k, v in c.items()), F.lit(c["general"]))

    def categories(self, t: Column, s: Column) -> Column:
        both, out = F.concat(t, F.lit(" "), s), []
        for c in self.config["categories"]:
            x = t if c.get("scope") == "title" else both
            x = F.regexp_replace(x, "『[^』]*』|「[^」]*」", " ") if c.get("skipQuoted") else x
            out.append((c["id"], any_of(without(x, c.get("ignore", ())), c["keywords"])))
        return labels(out)

    def platforms(self, t: Column, s: Column) -> Column:
        both = F.concat(t, F.lit(" "), s)
        return labels([(p["id"], any_of(without(both, p.get("exclude", ())), p["keywords"])) for p in self.config.get("platforms", {}).get("list", ())])

    def deal(self, t: Column, s: Column) -> Column:
        """struct<stores, off, free>, or null: signals and exclusions in the title, stores in both texts, the highest percentage up to 100."""
        d = self.config["deals"]
        stores = labels([(x["id"], matches(F.concat(t, F.lit(" "), s), [x["pattern"]])) for x in d["stores"]])
        units = "|".join(map(re.escape, d.get("units", ("off",))))
        offs = F.transform(F.regexp_extract_all(t, F.lit(DISCOUNT % units), F.lit(1)), lambda x: x.cast("int"))
        off = F.array_max(F.filter(offs, lambda x: (x > 0) & (x <= 100)))
        return F.when(matches(t, d["signals"]) & ~matches(t, d["exclude"]), F.struct(stores.alias("stores"), off.alias("off"), matches(t, d.get("free", ())).alias("free")))

    def spoiler(self, t: Column) -> Column:
        has = lambda k: matches(t, self.config["spoiler"].get(k, ()))
        return F.when(has("never"), False).when(has("explicit"), True).when(has("safe"), False).when(has("strong"), True).otherwise(has("episode") & has("reaction"))

    def off_topic(self, t: Column, score: Column) -> Column:
        """score is the one without a bonus for known names."""
        o = self.config["offTopic"]
        return matches(t, o["signals"], "") & ~any_of(t, o["gameOriginWorks"]) & (score <= 0)

    def canonical(self, work: Column) -> Column:
        """Prefixes in their order, each once, where more than a character is left; then suffixes. Each step names the one before once, as nothing is shared inside a lambda."""
        w, c = fold(work), self.config["works"]
        for p in c["stripPrefixes"]:
            w = F.regexp_replace(w, rf"(?s)^{re.escape(p)}(?=..){BLANK}*", "")
        for p in c["stripSuffixPatterns"]:
            w = trimmed(F.regexp_replace(w, "(?i)" + java(p), ""))
        return w

    def work_key(self, work: Column) -> Column:
        """What spellings of one name share: aliases, Roman numerals behind known prefixes as digits, no blanks, dots, colons, waves or marks; hyphens stay."""
        k, c = F.lower(fold(work)), self.config["works"]
        for a, b in c.get("aliases", {}).items():
            k = F.replace(k, F.lit(folded(a).lower()), F.lit(folded(b).lower()))
        prefixes = "|".join(re.escape(folded(p).lower()) for p in c.get("numeralPrefixes", ()))
        if prefixes:
            numbered = k
            for n in sorted(range(1, len(ROMAN) + 1), key=lambda n: -len(ROMAN[n - 1])):
                numbered = F.regexp_replace(numbered, rf"({prefixes}) ?{ROMAN[n - 1]}(?![a-z])", rf"$1{n}")
            k = F.when(F.rlike(k, F.lit(rf"(?:{prefixes}) ?[ivx]")), numbered).otherwise(k)
        return F.regexp_replace(k, rf"(?:{BLANK}|[{KEY_MARKS}])+", "")

    def works(self, title: Column, lenient: Column | bool = False) -> Column:
        """Names in a title: in double quotes; in corner quotes behind a context word, or where `lenient` holds and the configuration does not forbid it, short ones without marks of speech; in quotes at the start. In order, no name twice."""
        c, text = self.config["works"], F.coalesce(title, F.lit(""))
        context = re.sub(r"(?<!\\)\$\Z", "", c["cornerQuoteContextPattern"])
        strict = f"(?:{context}){IN_CORNER_QUOTES}"
        corner = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.regexp_extract(x, "「([^」]*)」", 1))
        quoted = corner(strict)
        if lenient is not False and c.get("lenientCornerQuotes", True):
            loose = corner(f"{strict}|{SHORT_IN_CORNER_QUOTES % NO_NAME}")
            quoted = loose if lenient is True else F.when(lenient, loose).otherwise(quoted)
        found = F.concat(F.regexp_extract_all(text, F.lit(IN_DOUBLE_QUOTES), F.lit(1)), quoted, F.regexp_extract_all(text, F.lit(AT_START), F.lit(1)))
        ignore = [F.lit(w) for w in c["ignore"]]
        return F.array_distinct(F.filter(F.transform(found, self.canonical), lambda w: (F.length(w) >= 2) & (~w.isin(ignore) if ignore else F.lit(True))))

    def syndicated(self, source: Column, link: Column) -> Column:
        """The source is a portal by name, or the link's host by domain."""
        s = self.config["syndication"]
        host = F.coalesce(F.try_parse_url(link, F.lit("HOST")), F.lit(""))
        return F.lower(fold(source)).isin([folded(p).lower() for p in s["portals"]]) | either([(host == h) | F.endswith(host, F.lit("." + h)) for h in s["hosts"]])

    def sensitive(self) -> list[str]:
        return [c["id"] for c in self.config["categories"] if c.get("sensitive")]


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. As the output of a generator they can't be put into the conditions that use them, which the optimizer does with plain columns, once a use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def known_works(items: DataFrame, rules: RuleSet, lang: str = "ja") -> DataFrame:
    """key: the names in titles of one language's specialist sources, whether these were accepted or not."""
    names = items.where((F.col("kind") == "specialist") & (F.col("lang") == lang)).select(F.explode(rules.works(F.col("title"), True)).alias("w"))
    return names.select(rules.work_key(F.col("w")).alias("key")).distinct()


def judged(items: DataFrame, rules: RuleSet, known: DataFrame | None = None) -> DataFrame:
    """Accepted items with match_title, score, hits, cats, plats, works, deal, spoiler, syndicated and shown_source.

    items: ord (unique), title, summary, kind, source, link, min_score, and others, which stay. Known names are joined by key, so they may
    be as many as there are.
    """
    title, kind, t, s = F.col("title"), F.col("kind"), F.col("t_"), F.col("s_")
    x = settled(items.withColumn("title", F.regexp_replace(F.coalesce("title", F.lit("")), PHOTO, "")), t_=fold(title), s_=fold(F.col("summary")))
    x = x.where(~rules.hard_excluded(t, s)).withColumn("match_title", unsourced(publisher_of(title)[0])).drop("t_")
    x = settled(x, t_=fold(F.col("match_title")))
    plain, hits = rules.score(t, s)
    x = settled(x, score=plain).where(~rules.off_topic(t, F.col("score"))).withColumn("hits", hits).withColumn("works", rules.works(F.col("match_title"), kind == "specialist"))
    if known is not None:
        # from the titles alone, so that what is judged of x is not computed again
        bare = F.regexp_replace(F.coalesce("title", F.lit("")), PHOTO, "")
        named = items.select("ord", F.explode(rules.works(unsourced(publisher_of(bare)[0]), True)).alias("w"))
        met = named.select("ord", rules.work_key(F.col("w")).alias("key")).join(known, "key", "left_semi").select("ord").distinct()
        x = x.join(met.withColumn("met", F.lit(True)), "ord", "left")
        x = x.withColumn("score", F.col("score") + F.when(F.col("met"), rules.config["relevance"]["knownWorkBonus"]).otherwise(0))
        x = x.withColumn("hits", F.when(F.col("met"), F.concat("hits", F.array(F.lit("#known-work")))).otherwise(F.col("hits"))).drop("met")
    x = x.where((kind == "specialist") | (F.col("score") >= rules.threshold(kind, F.col("min_score"))))
    x = x.withColumn("deal", rules.deal(t, s)).withColumn("plats", rules.platforms(t, s)).withColumn("spoiler", rules.spoiler(t)).withColumn("cats", rules.categories(t, s)).drop("t_", "s_")
    sale = F.array(F.lit("sale"))
    x = x.withColumn("cats", F.when(F.col("deal").isNull(), F.array_except("cats", sale)).otherwise(F.array_union("cats", sale)))
    x = x.withColumn("syndicated", rules.syndicated(F.col("source"), F.col("link")))
    original = trimmed(F.regexp_extract("title", rf"[（(]([^（）()]{{1,30}})[）)]{BLANK}*\z", 1))
    return x.withColumn("shown_source", F.when(F.col("syndicated") & (original != ""), F.concat(original, F.lit("（"), "source", F.lit("）"))).otherwise(F.col("source")))


def deal_label(deal: Column, free: str = "Free", other: str = "Sale") -> Column:
    return F.when(deal["free"], free).when(deal["off"].isNotNull(), F.concat(F.lit("-"), deal["off"].cast("string"), F.lit("%"))).when(deal.isNotNull(), other)


def current_deals(items: DataFrame, rules: RuleSet, now: int, days: int = 7) -> DataFrame:
    """Deals of the last days, or undated, that are on no sensitive matter; newest first."""
    fresh = F.col("pub").isNull() | (F.col("pub") >= now - days * 86400)
    calm = ~F.arrays_overlap("cats", F.array(*map(F.lit, rules.sensitive()))) if rules.sensitive() else F.lit(True)
    return items.where(F.col("deal").isNotNull() & fresh & calm).orderBy(F.desc_nulls_last("pub"), "ord")
