"""Higher-order SQL expressions over nested records, written for Spark and for DuckDB.

An operator that is one projection over nested arrays is stated once as a
function of a ``Dialect``; Spark evaluates it JVM-side in the scan's stage and
DuckDB serves as the oracle.
"""

from __future__ import annotations


class Dialect:
    """Spark SQL."""

    spark = True

    def empty(self, kind: str = "string") -> str:
        return f"CAST(array() AS array<{kind}>)"

    def filter(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def map(self, a: str, v: str, out: str) -> str:
        return f"transform({a}, {v} -> {out})"

    def size(self, a: str) -> str:
        return f"coalesce(size({a}), 0)"

    def count(self, a: str, v: str, cond: str) -> str:
        return self.size(self.filter(a, v, cond))

    def range(self, n: str) -> str:
        return f"if({n} < 1, CAST(array() AS array<int>), sequence(0, CAST({n} AS int) - 1))"

    def at(self, a: str, i: str) -> str:
        """Element ``i`` (from 0), null beyond the ends."""
        return f"get({a}, CAST({i} AS int))"

    def flat(self, a: str, v: str, inner: str, kind: str) -> str:
        """The inner arrays as one; ``kind`` names their type for readers, pruned structs are flattened as they are."""
        return f"flatten(filter(transform({a}, {v} -> {inner}), inner_ -> inner_ IS NOT NULL))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def except_(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def has(self, a: str, x: str) -> str:
        return f"coalesce(array_contains({a}, {x}), false)"

    def sum(self, a: str, v: str, x: str) -> str:
        return f"aggregate({a}, CAST(0 AS bigint), (acc_, {v}) -> acc_ + coalesce({x}, 0))"

    def max(self, a: str) -> str:
        return f"array_max({a})"

    def min(self, a: str) -> str:
        return f"array_min({a})"

    def matches(self, x: str, pattern: str) -> str:
        return f"coalesce({x} rlike r'{pattern}', false)"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', {group})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, '\\\\Q{sep}\\\\E')" if sep != "\\n" else f"split({x}, '\\n')"

    def round(self, x: str, n: int) -> str:
        return f"bround(CAST({x} AS double), {n})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def keys(self, m: str) -> str:
        return f"map_keys({m})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def time(self, x: str) -> str:
        """An ISO-8601 text as microseconds, null if it is none; without a zone it is UTC."""
        iso = self.matches(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:?[0-9]{2})?$")
        return f"(CASE WHEN {iso} THEN unix_micros(try_to_timestamp({x})) END)"

    def double(self, x: str) -> str:
        return f"CAST({x} AS double)"

    def slice(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})"

    def struct(self, **cols: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in cols.items()) + ")"


class Duck(Dialect):
    spark = False

    def empty(self, kind: str = "string") -> str:
        return "[]"

    def filter(self, a: str, v: str, cond: str) -> str:
        return f"list_filter({a}, lambda {v}: {cond})"

    def map(self, a: str, v: str, out: str) -> str:
        return f"list_transform({a}, lambda {v}: {out})"

    def size(self, a: str) -> str:
        return f"coalesce(len({a}), 0)"

    def range(self, n: str) -> str:
        return f"range(CAST({n} AS BIGINT))"

    def at(self, a: str, i: str) -> str:
        return f"({a})[CAST({i} AS BIGINT) + 1]"

    def flat(self, a: str, v: str, inner: str, kind: str) -> str:
        return f"flatten(list_transform({a}, lambda {v}: coalesce({inner}, [])))"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def except_(self, a: str, b: str) -> str:
        return f"list_filter(list_distinct({a}), lambda e_: NOT coalesce(list_contains({b}, e_), false))"

    def has(self, a: str, x: str) -> str:
        return f"coalesce(list_contains({a}, {x}), false)"

    def sum(self, a: str, v: str, x: str) -> str:
        return f"CAST(coalesce(list_sum(list_transform({a}, lambda {v}: coalesce({x}, 0))), 0) AS BIGINT)"

    def max(self, a: str) -> str:
        return f"list_max({a})"

    def min(self, a: str) -> str:
        return f"list_min({a})"

    def matches(self, x: str, pattern: str) -> str:
        return f"coalesce(regexp_matches({x}, '{pattern}'), false)"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, '{sep}')" if sep != "\\n" else f"string_split({x}, chr(10))"

    def round(self, x: str, n: int) -> str:
        return f"round_even(CAST({x} AS double), {n})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def time(self, x: str) -> str:
        iso = self.matches(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:?[0-9]{2})?$")
        return f"(CASE WHEN {iso} THEN epoch_us(TRY_CAST({x} AS TIMESTAMPTZ)) END)"

    def slice(self, a: str, n: int) -> str:
        return f"({a})[1:{n}]"

    def struct(self, **cols: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in cols.items()) + "}"


SPARK, DUCK = Dialect(), Duck()
