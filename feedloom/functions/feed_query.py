"""The state of an interactive query: to and from a query string, the usual clicks, and one condition a term."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.facets import facet_counts
from .search import normal, searchable

PERIODS = {"all": None, "24h": 24 * 3600, "3d": 72 * 3600, "7d": 168 * 3600}
#: Parameters of a query string: sets as comma-separated lists, enumerations with their values (the default first), switches.
SETS, ENUMS, SWITCHES = ("cat", "plat", "store"), {"period": tuple(PERIODS), "sort": ("new", "hot"), "lang": ("ja", "all", "en")}, ("deal", "new")


@dataclass(frozen=True)
class FeedQuery:
    q: str = ""
    cat: frozenset = frozenset()
    plat: frozenset = frozenset()
    store: frozenset = frozenset()
    deal: bool = False
    new: bool = False
    period: str = "all"
    sort: str = "new"
    lang: str = "ja"
    work: str = ""
    mute: tuple = ()
    follow: tuple = ()
    hidden_sources: frozenset = frozenset()
    hidden_topics: frozenset = frozenset()
    only_follow: bool = False
    spoiler_blur: bool = True
    hide_read: bool = False
    multi_only: bool = False

    @classmethod
    def from_url(cls, query: str, known: dict[str, set] | None = None, **prefs) -> FeedQuery:
        """Unknown values are dropped and enumerations fall back to their default; a store implies deals."""
        p = {k: v[-1] for k, v in parse_qs(query.lstrip("?")).items()}
        got = {k: frozenset(x for x in p.get(k, "").split(",") if x and (known is None or x in known.get(k, ()))) for k in SETS}
        got |= {k: p[k] for k, allowed in ENUMS.items() if p.get(k) in allowed} | {k: p.get(k) == "1" for k in SWITCHES}
        got["deal"] = got["deal"] or bool(got["store"])
        return cls(q=p.get("q", ""), work=p.get("work", ""), **got, **prefs)

    def to_url(self) -> str:
        """Only what differs from the defaults."""
        p = {"q": self.q, "work": self.work} | {k: ",".join(sorted(getattr(self, k))) for k in SETS}
        p |= {k: "" if getattr(self, k) == allowed[0] else getattr(self, k) for k, allowed in ENUMS.items()}
        p |= {"deal": "1" if self.deal and not self.store else "", "new": "1" if self.new else ""}
        return urlencode({k: v for k, v in p.items() if v})

    def reset(self) -> FeedQuery:
        return FeedQuery(mute=self.mute, follow=self.follow, hidden_topics=self.hidden_topics, spoiler_blur=self.spoiler_blur)

    def toggle(self, facet: str, value: str) -> FeedQuery:
        out = replace(self, **{facet: getattr(self, facet) ^ {value}})
        return replace(out, deal=True) if facet == "store" and out.store else out

    def pick(self, facet: str, value: str) -> FeedQuery:
        """A suggestion clears the text and replaces the facet."""
        return replace(self, q="", **{facet: value if facet == "work" else frozenset({value})})

    def set_deal(self, on: bool) -> FeedQuery:
        return replace(self, deal=on, store=self.store if on else frozenset())

    def terms(self, now: int, visit: int = 0) -> dict[str, Column]:
        """Conditions over items with source, lang, pub, seen, cats, plats, deal (a flag), stores, works, originals, is_read, hay."""
        t, over = {}, lambda c, v: F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, sorted(v)))), F.lit(False))
        if self.hidden_sources:
            t["source"] = ~F.col("source").isin(sorted(self.hidden_sources))
        if self.lang != "all":
            t["lang"] = F.col("lang") == self.lang
        if PERIODS[self.period]:
            t["period"] = F.coalesce(F.col("pub") >= now - PERIODS[self.period], F.lit(False))
        for k, c in (("cat", "cats"), ("plat", "plats")):
            if getattr(self, k):
                t[k] = over(c, getattr(self, k))
        if self.deal:
            t["deal"] = F.col("deal")
            if self.store:
                t["store"] = over("stores", self.store)
        if self.work:
            t["work"] = F.array_contains("works", self.work)
        if self.only_follow and self.follow:
            t["follow"] = over("works", self.follow)
        if self.multi_only:
            t["multi"] = F.col("originals") > 0
        if self.hide_read:
            t["read"] = ~F.col("is_read")
        if self.new:
            t["new"] = (F.col("seen") > visit) & F.lit(visit > 0)
        for i, w in enumerate(normal(self.q).split()):
            hay = F.coalesce("hay", F.lit(""))
            t[f"text{i}"] = ~F.contains(hay, F.lit(w[1:])) if w.startswith("-") and len(w) > 1 else F.contains(hay, F.lit(w))
        return t

    def disposition(self, now: int, visit: int = 0) -> Column:
        """rejected, hidden, muted or shown; a row both hidden and muted counts as hidden."""
        ok = F.coalesce(reduce(Column.__and__, self.terms(now, visit).values(), F.lit(True)), F.lit(False))
        hidden = F.coalesce(F.arrays_overlap("cats", F.array(*map(F.lit, sorted(self.hidden_topics)))), F.lit(False)) if self.hidden_topics else F.lit(False)
        muted = F.coalesce(reduce(Column.__or__, [F.contains("hay", F.lit(normal(m))) for m in self.mute], F.lit(False)), F.lit(False))
        return F.when(~ok, "rejected").when(hidden, "hidden").when(muted, "muted").otherwise("shown")

    def counted(self, items: DataFrame, now: int, visit: int = 0) -> DataFrame:
        """facet, value, n over items that are neither hidden nor muted: each facet leaves out its own term, deals their stores too."""
        terms = self.terms(now, visit)
        text = [k for k in terms if k.startswith("text")]
        conditions = {k: v for k, v in terms.items() if k not in text} | {"text": reduce(Column.__and__, (terms[k] for k in text), F.lit(True))}
        shown = ~F.coalesce(F.arrays_overlap("cats", F.array(*map(F.lit, sorted(self.hidden_topics)))), F.lit(False)) if self.hidden_topics else F.lit(True)
        muted = F.coalesce(reduce(Column.__or__, [F.contains("hay", F.lit(normal(m))) for m in self.mute], F.lit(False)), F.lit(False))
        deals = F.when(F.col("deal"), F.array(F.lit("deal"))).otherwise(F.array().cast("array<string>"))
        stores = F.when(F.col("deal"), F.col("stores")).otherwise(F.array().cast("array<string>"))
        facets = {"cat": (F.col("cats"), ("cat",)), "plat": (F.col("plats"), ("plat",)), "lang": (F.array("lang"), ("lang",)), "deal": (deals, ("deal", "store")), "store": (stores, ("store",))}
        return facet_counts(items.where(shown & ~muted), conditions, facets)

    def apply(self, items: DataFrame, now: int, visit: int = 0) -> DataFrame:
        order = [F.desc_nulls_last("pub"), F.col("ord")]
        return items.where(self.disposition(now, visit) == "shown").orderBy(*([F.desc("originals")] if self.sort == "hot" else []), *order)


def interactive(items: DataFrame) -> DataFrame:
    """Judged items with what terms() reads: hay, deal as a flag, stores, originals (other sources that are no reposts), seen, is_read."""
    stores = F.coalesce("deal.stores", F.array().cast("array<string>"))
    x = items.withColumn("stores", stores).withColumn("deal", F.col("deal").isNotNull())
    x = x.withColumn("hay", searchable(F.concat_ws(" ", "title", "summary", F.array_join("works", " "), "source")))
    others = F.size(F.filter(F.slice("sources", 2, F.greatest(F.size("sources"), F.lit(1))), lambda s: ~F.coalesce(s["syndicated"], F.lit(False)))) if "sources" in items.columns else F.lit(0)
    x = x.withColumn("originals", others)
    return x if "seen" in items.columns else x.withColumn("seen", F.col("pub"))


DEFAULTS = {f.name: f.default for f in fields(FeedQuery)}
