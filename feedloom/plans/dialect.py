"""The few places where Spark SQL and DuckDB differ, so that one declarative plan can be run and checked on both."""

from __future__ import annotations

import re


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "r'" + s.replace("'", "\\x27") + "'"

    def rx(self, e: str, pattern: str) -> str:
        return f"regexp_like({e}, {self.lit(pattern)})"

    def sub(self, e: str, pattern: str, to: str) -> str:
        return f"regexp_replace({e}, {self.lit(pattern)}, '{to}')"

    def get(self, e: str, pattern: str, group: int) -> str:
        return f"regexp_extract({e}, {self.lit(pattern)}, {group})"

    def all(self, e: str, pattern: str, group: int) -> str:
        return f"regexp_extract_all({e}, {self.lit(pattern)}, {group})"

    def secs(self, e: str) -> str:
        return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {e})"

    def each(self, arr: str, alias: str) -> str:
        return f"LATERAL VIEW explode({arr}) ex_{alias} AS {alias}"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def tags(self, pairs: list[tuple[str, str]]) -> str:
        """Array of the labels whose condition holds, in order."""
        return "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in pairs) + "))"

    def grams(self, e: str) -> str:
        return f"CASE WHEN length({e}) = 0 THEN array() WHEN length({e}) = 1 THEN array({e}) ELSE array_distinct(transform(sequence(1, length({e}) - 1), i -> substring({e}, i, 2))) END"

    def both(self, a: str, b: str) -> str:
        return f"CAST(size(array_intersect({a}, {b})) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def maxint(self, a: str) -> str:
        return f"array_max(filter(transform({a}, x -> CAST(x AS BIGINT)), x -> x > 0 AND x <= 100))"

    def count(self, e: str, needle: str) -> str:
        return f"(length({e}) - length(replace({e}, '{needle}', '')))"


    def first_line(self, e: str) -> str:
        return f"substring_index({e}, chr(10), 1)"

    def low(self, e: str) -> str:
        """A text in lower case. Those of the items are columns of theirs, made once: every word is sought in them."""
        return f"low_{e}" if e in ("title", "summary", "whole") else e if e == "bound" else f"lower({e})"

    def each_in(self, e: str, test) -> str:
        """A test that seeks several words in one text, which is worked out and put in lower case once."""
        return f"element_at(transform(array(lower({e})), bound -> {test('bound')}), 1)"

    def lowered(self) -> str:
        return ", lower(title) AS low_title, lower(summary) AS low_summary, lower(concat(title, ' ', summary)) AS low_whole"

    def word(self, e: str, pattern: str, words: list[str]) -> str:
        """Whether one of the words, of which the pattern is made, stands in a lower-cased text between characters that are no letters or digits. Many texts hold none, which a plain search tells sooner; each is sought by its letters first, and what stands before them is looked at after."""
        found = lambda w, p: f"contains({e}, '{w}') AND {self.rx(e, f'{p}(?<![a-z0-9]{p})(?![a-z0-9])')}"
        return "(" + " OR ".join(found(w, re.escape(w).replace(chr(92) + " ", " ")) for w in words) + ")"

    def quote(self) -> str:
        return "chr(39)"

    def references(self, e: str) -> str:
        """Decimal character references as their characters, however many zeros they begin with; what is no character stays."""
        codes = f"filter(array_distinct(regexp_extract_all({e}, r'&#(0*[0-9]{{1,7}});', 1)), n -> CAST(n AS BIGINT) BETWEEN 1 AND 55295 OR CAST(n AS BIGINT) BETWEEN 57344 AND 1114111)"
        return f"aggregate({codes}, {e}, (s, n) -> replace(s, concat('&#', n, ';'), decode(unhex(lpad(hex(CAST(n AS BIGINT)), 8, '0')), 'UTF-32')))"


class Duck(Spark):
    name = "duckdb"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "\\x27") + "'"

    def rx(self, e: str, pattern: str) -> str:
        return f"regexp_matches({e}, {self.lit(pattern)})"

    def sub(self, e: str, pattern: str, to: str) -> str:
        return f"regexp_replace({e}, {self.lit(pattern)}, '{to}', 'g')"

    def first_line(self, e: str) -> str:
        return f"split_part({e}, chr(10), 1)"

    def low(self, e: str) -> str:
        return f"lower({e})"

    def each_in(self, e: str, test) -> str:
        return test(e)

    def lowered(self) -> str:
        return ""

    def word(self, e: str, pattern: str, words: list[str]) -> str:
        return self.rx(e, f"(^|[^a-z0-9]){pattern}($|[^a-z0-9])")

    def secs(self, e: str) -> str:
        return f"CAST(floor(epoch({e})) AS BIGINT)"

    def each(self, arr: str, alias: str) -> str:
        return f", unnest({arr}) AS ex_{alias}({alias})"

    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def tags(self, pairs: list[tuple[str, str]]) -> str:
        return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in pairs) + "], lambda x: x IS NOT NULL)"

    def grams(self, e: str) -> str:
        return f"CASE WHEN length({e}) = 0 THEN [] WHEN length({e}) = 1 THEN [{e}] ELSE list_distinct(list_transform(generate_series(1, length({e}) - 1), lambda i: substr({e}, i, 2))) END"

    def both(self, a: str, b: str) -> str:
        return f"CAST(len(list_intersect({a}, {b})) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def maxint(self, a: str) -> str:
        return f"list_max(list_filter(list_transform({a}, lambda x: CAST(x AS BIGINT)), lambda x: x > 0 AND x <= 100))"

    def references(self, e: str) -> str:
        codes = f"list_filter(list_distinct(regexp_extract_all({e}, '&#(0*[0-9]{{1,7}});', 1)), lambda n: CAST(n AS BIGINT) BETWEEN 1 AND 55295 OR CAST(n AS BIGINT) BETWEEN 57344 AND 1114111)"
        return f"list_reduce(list_concat([{e}], {codes}), lambda s, n: replace(s, concat('&#', n, ';'), chr(CAST(n AS INTEGER))))"
