"""One relational plan, two engines: the few spellings in which Spark SQL and DuckDB differ."""

from __future__ import annotations


class Spark:
    """Spark SQL. Patterns are case-insensitive unless ``case`` is set; none uses look-around."""

    name = "spark"
    newline = "'\\n'"

    def text(self, s: str) -> str:
        quote = '"' if "'" in s else "'"
        return f"r{quote}{s}{quote}"

    def pattern(self, p: str, case: bool = False) -> str:
        return self.text((p if case else f"(?i){p}").replace("'", r"\x27").replace('"', r"\x22"))

    def match(self, x: str, p: str, case: bool = False) -> str:
        return f"({x} RLIKE {self.pattern(p, case)})"

    def extract(self, x: str, p: str, group: int = 1, case: bool = False) -> str:
        return f"regexp_extract({x}, {self.pattern(p, case)}, {group})"

    def replace(self, x: str, p: str, by: str = "", case: bool = False) -> str:
        return f"regexp_replace({x}, {self.pattern(p, case)}, {self.text(by)})"

    def hits(self, x: str, p: str, case: bool = False) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p, case)}, 0)"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def kept(self, x: str, test: str) -> str:
        """Elements ``e`` of a list for which ``test`` holds."""
        return f"filter({x}, e -> {test})"

    def mapped(self, x: str, to: str) -> str:
        return f"transform({x}, e -> {to})"

    def unique(self, x: str) -> str:
        return f"array_distinct({x})"

    def joined(self, x: str, by: str) -> str:
        return f"array_join({x}, {self.text(by)})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.text(by)})"

    def lines(self, x: str) -> str:
        return f"split({x}, '\\n')"

    def list(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def pick(self, x: str, at: str) -> str:
        return f"element_at({x}, CAST({at} AS INT))"

    def head(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def sliced(self, x: str, n: str) -> str:
        """The first ``n`` elements, an expression."""
        return f"slice({x}, 1, CAST({n} AS INT))"

    def each(self, x: str) -> str:
        return f"explode({x})"

    def series(self, lo: str, hi: str) -> str:
        return f"sequence({lo}, {hi})"

    def div(self, a: str, b: str) -> str:
        return f"try_divide({a}, {b})"

    def half_even(self, x: str) -> str:
        return f"CAST(bround({x}) AS BIGINT)"

    def whole(self, x: str, sign: str) -> str:
        """``half_even`` times a sign, NULL for what no BIGINT holds."""
        # a cast of 2^63 itself gives the largest BIGINT
        return f"try_multiply(try_cast(nullif(bround({x}), 9223372036854775808D) AS BIGINT), {sign})"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def gathered(self, x: str, by: str, order: str) -> str:
        """A group's texts in order, as one text."""
        return f"listagg({x}, {self.text(by)}) WITHIN GROUP (ORDER BY {order})"

    def fixed(self, x: str, places: int) -> str:
        """A number with so many decimals and commas."""
        return f"format_number({x}, {places})"

    def ordered(self, x: str) -> str:
        return f"array_sort({x})"

    def in_order(self, x: str, order: str) -> str:
        """A group's values as a list in order."""
        return f"transform(sort_array(collect_list(struct({order} AS o, {x} AS x))), e -> e.x)"

    def sorted_list(self, x: str) -> str:
        return f"sort_array(collect_list({x}))"

    def values_set(self, x: str) -> str:
        return f"collect_set({x})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def last(self, x: str, window: str) -> str:
        """The last value that is not NULL."""
        return f"last_value({x}) IGNORE NULLS OVER ({window})"

    def first(self, x: str, window: str) -> str:
        return f"first_value({x}) IGNORE NULLS OVER ({window})"

    def bit(self, x: str, k: str) -> str:
        return f"(shiftright({x}, {k}) & 1)"

    def shift(self, n: str) -> str:
        return f"shiftleft(1, CAST({n} AS INT))"

    def mod(self, a: str, b: int) -> str:
        return f"pmod({a}, {b})"


class Duck(Spark):
    """DuckDB."""

    name = "duckdb"
    newline = "chr(10)"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def match(self, x: str, p: str, case: bool = False) -> str:
        return f"regexp_matches({x}, {self.pattern(p, case)})"

    def replace(self, x: str, p: str, by: str = "", case: bool = False) -> str:
        return f"regexp_replace({x}, {self.pattern(p, case)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def hits(self, x: str, p: str, case: bool = False) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p, case)})"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def kept(self, x: str, test: str) -> str:
        return f"list_filter({x}, lambda e: {test})"

    def mapped(self, x: str, to: str) -> str:
        return f"list_transform({x}, lambda e: {to})"

    def unique(self, x: str) -> str:
        return f"list_distinct({x})"

    def joined(self, x: str, by: str) -> str:
        return f"array_to_string({x}, {self.text(by)})"

    def split(self, x: str, by: str) -> str:
        return f"string_split_regex({x}, {self.text(by)})"

    def lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def list(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def pick(self, x: str, at: str) -> str:
        return f"({x})[CAST({at} AS INT)]"

    def head(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"

    def sliced(self, x: str, n: str) -> str:
        return f"({x})[1:{n}]"

    def each(self, x: str) -> str:
        return f"unnest({x})"

    def series(self, lo: str, hi: str) -> str:
        return f"range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1)"

    def div(self, a: str, b: str) -> str:
        return f"({a}) / nullif({b}, 0)"

    def half_even(self, x: str) -> str:
        return f"CAST(round_even({x}, 0) AS BIGINT)"

    def whole(self, x: str, sign: str) -> str:
        return f"{self.half_even(x)} * {sign}"

    def gathered(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, {self.text(by)} ORDER BY {order})"

    def fixed(self, x: str, places: int) -> str:
        return f"format('{{:,.{places}f}}', {x})"

    def ordered(self, x: str) -> str:
        return f"list_sort({x})"

    def in_order(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def sorted_list(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def values_set(self, x: str) -> str:
        return f"list_distinct(list({x}))"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def last(self, x: str, window: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({window})"

    def first(self, x: str, window: str) -> str:
        return f"first_value({x} IGNORE NULLS) OVER ({window})"

    def bit(self, x: str, k: str) -> str:
        return f"(({x} >> CAST({k} AS INT)) & 1)"

    def shift(self, n: str) -> str:
        return f"(1 << CAST({n} AS INT))"

    def mod(self, a: str, b: int) -> str:
        return f"(({a}) % {b} + {b}) % {b}"


SPARK, DUCK = Spark(), Duck()
