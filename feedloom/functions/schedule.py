"""Dated announcements in short texts: (date, verb) pairs, with the year inferred from the time of publication.

Each form of a date has a pattern of its own: a month and day, a month alone, numbers with a slash, a word for today. A year may stand before a
month. What follows a date, up to a limit, is read by the words of a configuration's block `schedule`: the verb nearest to the date
counts (ties: order of the verbs), unless the date is a deadline, the verb is void by what follows it, or a parting word or the end of a sentence
stands between. A date without a year is in the year of publication, local time, or in the next if it would lie more than
`backDays` back. Days up to 31 pass for every month, so dates stay strings. Texts are folded first. Null or empty texts give none, nor do
texts without a time of publication.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ruleset import folded

#: The block of a configuration, with words of our own.
DEFAULT = {
    "verbs": [
        {"id": "release", "keywords": ["発売", "リリース", "released", "launch", "out now"]},
        {"id": "start", "keywords": ["開始", "配信", "begins", "starts"]},
        {"id": "event", "keywords": ["開催", "is held"]},
        {"id": "end", "keywords": ["終了", "ends"]},
    ],
    "deadline": ["まで", "〆", "at the latest"],
    "void": ["見送り", "取りやめ", "中止", "延期", "した", "された", "ed earlier", " cancelled", " postponed"],
    "excludeBetween": ["抽選", "予約", "PV", "lottery", "preorder"],
    "today": ["本日", "today"],
    "skipIfMatches": [],
    "window": 16,
    "todayWindow": 6,
    "backDays": 150,
    "offsetHours": 9,
}
#: Where two forms begin at one place, the first of them is read. In folded texts a year stands in the six characters before its month.
FORMS = {"day": "{month}月 ?{day}日", "month": "{month}月", "slash": "(?<![0-9/]){month}/{day}(?![0-9/])"}
YEAR_BEFORE, YEAR_LENGTH, TERM = re.compile("([0-9]{4})年 ?$"), 6, "期"
IN_BRACKETS, SENTENCE_END = re.compile(r"\s*[（(][^）)]{1,3}[）)]"), re.compile("[。!?]")


@dataclass(frozen=True)
class ScheduleRules:
    """A configuration's block `schedule`; what it does not say is as in DEFAULT."""

    config: dict = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.config.get(key, DEFAULT[key])

    def words(self, key: str) -> list[str]:
        return [folded(w).lower() if key != "void" else w.lower() for w in self[key]]

    def forms(self) -> re.Pattern:
        """All forms in one pattern, so that a text is read once; a form's numbers are named after it."""
        number = lambda form: {k: f"(?P<{form}_{k}>[0-9]{{1,2}})" for k in ("month", "day")}
        today = "|".join(rf"(?<![A-Za-z0-9]){re.escape(w)}" for w in self["today"]) or "(?!)"
        return re.compile("|".join([*(f"(?P<{form}>{p.format(**number(form))})" for form, p in FORMS.items()), f"(?P<today>{today})"]), re.IGNORECASE)


RULES = ScheduleRules()


@dataclass(frozen=True)
class Reader:
    """What the rules come to, made once and not for each text."""

    forms: re.Pattern
    verbs: tuple
    deadline: tuple
    void: tuple
    between: tuple
    skip: tuple
    window: int
    today: int

    @classmethod
    def of(cls, rules: ScheduleRules) -> Reader:
        verbs = tuple((folded(w).lower(), k, verb["id"]) for k, verb in enumerate(rules["verbs"]) for w in verb["keywords"])
        return cls(rules.forms(), verbs, tuple(rules.words("deadline")), tuple(rules.words("void")), tuple(rules.words("excludeBetween")), tuple(re.compile(p, re.IGNORECASE) for p in rules["skipIfMatches"]), rules["window"], rules["todayWindow"])

    def dates(self, text: str):
        """(end, reach, year, month, day) of the dates in a folded text, from left to right; a day of None is a month alone, a year of None is not given, a month of None is today's date."""
        for m in self.forms.finditer(text):
            end, form, named = m.end(), next(f for f in (*FORMS, "today") if m[f] is not None), m.groupdict()
            if form == "today":
                yield end, self.today, None, None, None
                continue
            month, day = (None if n is None else int(n) for n in (named[f"{form}_month"], named.get(f"{form}_day")))
            year = YEAR_BEFORE.search(text[max(0, m.start() - YEAR_LENGTH) : m.start()]) if form != "slash" else None
            if form != "slash" and text.startswith(TERM, end):
                end, day = end + len(TERM), None
            if 1 <= month <= 12 and (day is None or 1 <= day <= 31):
                yield end, self.window, int(year[1]) if year else None, month, day

    def announced(self, behind: str) -> str | None:
        """The verb that the characters behind a date announce."""
        low = behind.lower()
        bracket = IN_BRACKETS.match(low)
        starts = {low.lstrip(), low[bracket.end() :].lstrip()} if bracket else {low.lstrip()}
        if any(s.startswith(self.deadline) for s in starts):
            return None
        found = [(at, k, verb, word) for word, k, verb in self.verbs if (at := low.find(word)) >= 0]
        if not found:
            return None
        at, _, verb, word = min(found, key=lambda f: f[:2])
        between, rest = low[:at], low[at + len(word) :]
        parted = SENTENCE_END.search(between) or any(w in between for w in self.between)
        return None if parted or rest.startswith(self.void) else verb

    def read(self, text: str) -> tuple:
        """(year, month, day, verb) of the announcements in a text, whatever its time of publication."""
        text = folded(text)
        if any(p.search(text) for p in self.skip):
            return ()
        return tuple((*date, verb) for end, reach, *date in self.dates(text) if (verb := self.announced(text[end : end + reach])))


def placed(found: tuple, pub: int, rules: ScheduleRules) -> list[tuple[str, str]]:
    """(date, verb) of what Reader.read() found in a text of that time, no pair twice."""
    today, out = (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=pub, hours=rules["offsetHours"])).date(), {}
    for year, month, day, verb in found:
        if month is None:
            year, month, day = today.year, today.month, today.day
        elif year is None:
            # a day that the month lacks is as far from its first as the number says
            then = datetime.date(today.year, month, 1) + datetime.timedelta(days=(day or 1) - 1)
            year = today.year + ((today - then).days > rules["backDays"])
        out.setdefault((f"{year:04d}-{month:02d}" + ("" if day is None else f"-{day:02d}"), verb))
    return list(out)


def announcements(text: str | None, pub: int | None, rules: ScheduleRules = RULES) -> list[tuple[str, str]]:
    if not text or pub is None:
        return []
    return placed(Reader.of(rules).read(text), int(pub), rules)


def schedules(text: str, pub: str, rules: ScheduleRules = RULES) -> Column:
    """array<struct<date, verb>> of two columns; positions in the text rule out plain SQL, so batches go through Arrow. What a text says is read once for all its copies in a batch; the years follow from each one's time."""

    @F.pandas_udf("array<struct<date: string, verb: string>>")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        reader, known, out = Reader.of(rules), {}, []
        for x, y in zip(t, p):
            if not x or pd.isna(y):
                out.append([])
                continue
            if x not in known:
                known[x] = reader.read(x)
            out.append([{"date": d, "verb": v} for d, v in placed(known[x], int(y), rules)] if known[x] else [])
        return pd.Series(out)

    return run(text, pub)


def calendar(items: DataFrame, now: int, rules: ScheduleRules = RULES, lang: str = "ja", back: int = 14, ahead: int = 400) -> DataFrame:
    """subject, date, verb, ord (the item shown) and sources of every announcement near `now` (seconds), by date, then most sources.

    items: ord, title, summary, pub, lang, work (its first name or null), subject (what makes announcements one: the name's key, else the
    title), sources (a number). The title counts; the summary only if the title announces nothing and there is a name. Of one subject,
    date and verb the sources are added up, and that item is shown which has more of its own than all before it have together.
    """
    x = items.where(F.col("lang") == lang).withColumn("found", schedules("title", "pub", rules))
    wanted = (F.size("found") == 0) & F.col("work").isNotNull() & (F.coalesce("summary", F.lit("")) != "")
    x = x.withColumn("found", F.when(wanted, schedules(F.when(wanted, F.col("summary")), "pub", rules)).otherwise(F.col("found")))
    x = x.select("ord", "subject", "sources", F.explode("found").alias("e")).select("ord", "subject", "sources", "e.date", "e.verb")
    first = F.make_date(F.substring("date", 1, 4).cast("int"), F.substring("date", 6, 2).cast("int"), F.lit(1))
    day = F.length("date") > 7
    start = F.when(day, F.date_add(first, F.substring("date", 9, 2).cast("int") - 1)).otherwise(first)
    end = F.when(day, F.date_add(start, 1)).otherwise(F.add_months(first, 1))
    seconds = lambda d: F.unix_date(d).cast("long") * 86400
    x = x.where((seconds(end) >= now - back * 86400) & (seconds(start) <= now + ahead * 86400))
    key = ["subject", "date", "verb"]
    before = F.sum("sources").over(Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("leads", F.when(before.isNull() | (F.col("sources") > before), F.col("ord")))
    return x.groupBy(*key).agg(F.max("leads").alias("ord"), F.sum("sources").alias("sources")).orderBy("date", F.desc("sources"), "subject", "verb")


def upcoming(entries: DataFrame, today: str, verbs=()) -> DataFrame:
    """Entries of this month on that name the month alone, and of today on that name the day; of some verbs, if any are given."""
    keep = F.when(F.length("date") > 7, F.col("date") >= today).otherwise(F.col("date") >= today[:7])
    return entries.where(keep & (F.col("verb").isin(list(verbs)) if verbs else F.lit(True)))


def by_month(entries: DataFrame) -> DataFrame:
    """month, loose (entries that name the month alone) and days (struct day, entries), each in order; months without entries are not there."""
    e = entries.groupBy(F.substring("date", 1, 7).alias("month"), "date").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("sources")).alias("s"), "subject", "verb", "ord"))), lambda x: x["ord"]).alias("entries"))
    loose = F.flatten(F.collect_list(F.when(F.length("date") == 7, F.col("entries"))))
    days = F.array_sort(F.collect_list(F.when(F.length("date") > 7, F.struct(F.col("date").alias("day"), "entries"))))
    return e.groupBy("month").agg(loose.alias("loose"), days.alias("days")).orderBy("month")
