"""Rule sets of the feed engine as data, and their compilation to one SQL condition each.

The word lists are this project's own and fit its test tables; an application passes others of the same shape.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    weights: dict = field(default_factory=lambda: {"that": 2, "with": 1, "license": 3, "of": -1, "der": 1, "que": 1, "###": -4, "trash": -3})
    thresholds: dict = field(default_factory=lambda: {"specialist": 0, "general": 3, "aggregator": 4, "press": 6})
    hard_title: tuple = ("THE THE THE", "!!")
    hard_any: tuple = ("idiot", "scum")
    off_signals: tuple = ("Th[a-z]+ing", "Der ")
    exempt: tuple = ("with", "que")
    categories: dict = field(default_factory=lambda: {"law": ("license", "licensed"), "motion": ("in", "from", "to"), "link": ("and", "und", "et", "y"), "place": ("at", "on", "la", "der")})
    platforms: dict = field(default_factory=lambda: {"alpha": (("the",), ("the the",)), "beta": (("is", "was"), ("it is",)), "gamma": (("de",), ("de la", "de los"))})
    spoiler: dict = field(default_factory=lambda: {"never": ("license",), "explicit": ("stupid", "clown"), "safe": ("with",), "strong": ("worthless",), "episode": ("of",), "reaction": ("that",)})
    sensitive: tuple = ("law",)


RULES = Rules()


def keyword(d, e: str, word: str) -> str:
    """ASCII words need a boundary that is no letter or digit, others are substrings; case never matters."""
    if re.fullmatch(r"[A-Za-z][A-Za-z0-9 .+-]*", word):
        return d.word(d.low(e), re.escape(word.lower()).replace(chr(92) + " ", " "), [word.lower()])
    return f"(instr({d.low(e)}, '{word.lower()}') > 0)"


def any_of(d, e: str, words) -> str:
    """An empty list holds for no text. One alternation for all ASCII words, so that a text is scanned once."""
    if not words:
        return "FALSE"
    plain = [w for w in words if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", w)]
    parts = [keyword(d, e, w) for w in words if w not in plain]
    if plain:
        low = [w.lower() for w in plain]
        parts.append(d.word(d.low(e), f"({'|'.join(low)})", low))
    return "(" + " OR ".join(parts) + ")"


def score(d, rules: Rules, title: str, summary: str) -> str:
    """A title hit counts twice if its weight is positive, else once; a summary hit counts only without a title hit."""
    return "(" + " + ".join(f"CASE WHEN {keyword(d, title, w)} THEN {2 * v if v > 0 else v} WHEN {keyword(d, summary, w)} THEN {v} ELSE 0 END" for w, v in rules.weights.items()) + ")"


def verdict(d, rules: Rules, text: str) -> str:
    """Decision list: never, explicit, safe, strong, then episode and reaction."""
    has = lambda k: any_of(d, text, rules.spoiler[k])
    return f"CASE WHEN {has('never')} THEN FALSE WHEN {has('explicit')} THEN TRUE WHEN {has('safe')} THEN FALSE WHEN {has('strong')} THEN TRUE ELSE ({has('episode')} AND {has('reaction')}) END"


def tagged(d, rules: Rules, title: str, both: str) -> str:
    return d.tags([(k, any_of(d, both, words)) for k, words in rules.categories.items()])


def platforms(d, rules: Rules, e: str) -> str:
    """Excluded longer terms are taken out (case-sensitively) before the keywords are tested."""
    pairs = []
    for k, (words, without) in rules.platforms.items():
        x = e
        for w in without:
            x = f"replace({x}, '{w}', '')"
        pairs.append((k, d.each_in(x, lambda t, words=words: any_of(d, t, words))))
    return d.tags(pairs)
