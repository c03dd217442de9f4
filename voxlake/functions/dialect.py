"""Expressions whose spelling differs between Spark SQL and the oracle's SQL."""

from __future__ import annotations


class Spark:
    name = "spark"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def pct(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def hexint(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) AS bigint)"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def words(self, x: str) -> str:
        return rf"filter(split({x}, r'[ \t\n\r]+'), w -> w <> '')"

    def size(self, x: str) -> str:
        return f"size({x})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def joined(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ';')"

    def explode(self, x: str, name: str) -> str:
        return f"explode({x}) AS {name}"

    def seconds(self, x: str) -> str:
        return f"unix_micros(cast({x} AS timestamp)) / 1e6"

    def hour(self, x: str) -> str:
        return f"cast(date_trunc('hour', {x}) AS timestamp_ntz)"

    def arg_max(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def arg_min(self, x: str, by: str) -> str:
        return f"min_by({x}, {by})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, r'{pattern}')"

    def first_group(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, r'{pattern}', 1)"

    def finite(self, x: str) -> str:
        return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('infinity'))"

    def nan(self) -> str:
        return "double('NaN')"

    def infinity(self) -> str:
        return "double('infinity')"

    def filter(self, x: str, condition: str) -> str:
        """Elements w of x with the condition on w."""
        return f"filter({x}, w -> {condition})"

    def map(self, x: str, expression: str) -> str:
        return f"transform({x}, w -> {expression})"

    def some(self, x: str, condition: str) -> str:
        return f"exists({x}, w -> {condition})"

    def at(self, x: str, i: str) -> str:
        """Element i of x, from 1; null beyond it."""
        return f"try_element_at({x}, CAST({i} AS int))"

    def glued(self, x: str, by: str = " ") -> str:
        return f"array_join({x}, '{by}')"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, '{by}')"

    def part(self, x: str, low: str, n: str) -> str:
        """n elements of x from the low-th on."""
        return f"slice({x}, CAST({low} AS int), CAST({n} AS int))"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def gathered(self, x: str, order: str) -> str:
        """Values of x in a group, in the order of a key that is unique there."""
        return f"transform(array_sort(collect_list(struct({order} AS k, {x} AS v))), w -> w.v)"

    def distinct_sorted(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def range(self, low: str, high: str) -> str:
        """Integers low..high as an array; both ends are in it."""
        return f"sequence({low}, {high})"

    def bool_or(self, x: str) -> str:
        return f"bool_or({x})"

    def count_if(self, x: str) -> str:
        return f"count_if({x})"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)"

    def prefix(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def suffix(self, x: str, y: str) -> str:
        return f"endswith({x}, {y})"


class Duck(Spark):
    name = "duck"

    def sha(self, x):
        return f"sha256({x})"

    def pct(self, x, q):
        return f"quantile_cont({x}, {q})"

    def hexint(self, x):
        return f"('0x' || {x})::BIGINT"

    def replace(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def words(self, x):
        return rf"list_filter(regexp_split_to_array({x}, '[ \t\n\r]+'), lambda w: w <> '')"

    def size(self, x):
        return f"len({x})"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"

    def joined(self, x):
        return f"string_agg(DISTINCT {x}, ';' ORDER BY {x})"

    def explode(self, x, name):
        return f"unnest({x}) AS {name}"

    def seconds(self, x):
        return f"epoch_us({x}) / 1e6"

    def hour(self, x):
        return f"date_trunc('hour', {x})"

    def arg_max(self, x, by):
        return f"arg_max({x}, {by})"

    def arg_min(self, x, by):
        return f"arg_min({x}, {by})"

    def like(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def first_group(self, x, pattern):
        return f"regexp_extract({x}, '{pattern}', 1)"

    def finite(self, x):
        return f"({x} IS NOT NULL AND isfinite({x}))"

    def nan(self):
        return "'NaN'::DOUBLE"

    def infinity(self):
        return "'infinity'::DOUBLE"

    def filter(self, x, condition):
        return f"list_filter({x}, lambda w: {condition})"

    def map(self, x, expression):
        return f"list_transform({x}, lambda w: {expression})"

    def some(self, x, condition):
        return f"(len(list_filter({x}, lambda w: {condition})) > 0)"

    def at(self, x, i):
        return f"({x})[CAST({i} AS int)]"

    def glued(self, x, by=" "):
        return f"array_to_string({x}, '{by}')"

    def split(self, x, by):
        return f"string_split({x}, '{by}')"

    def part(self, x, low, n):
        return f"({x})[CAST({low} AS int):CAST({low} AS int) + CAST({n} AS int) - 1]"

    def array(self, *x):
        return f"[{', '.join(x)}]"

    def gathered(self, x, order):
        return f"list({x} ORDER BY {order})"

    def distinct_sorted(self, x):
        return f"string_agg(DISTINCT {x}, ',' ORDER BY {x})"

    def range(self, low, high):
        return f"range({low}, {high} + 1)"

    def count_if(self, x):
        return f"CAST(count_if({x}) AS bigint)"

    def median(self, x):
        return f"quantile_cont({x}, 0.5)"

    def prefix(self, x, y):
        return f"starts_with({x}, {y})"

    def suffix(self, x, y):
        return f"suffix({x}, {y})"


def digest_mod(d: Spark, digest: str, chunks: int, base: int = 100) -> str:
    """Whole hex digest modulo base, folded over chunks of eight digits (2^32 mod 100 is 96)."""
    step, out = (1 << 32) % base, "0"
    for i in range(chunks):
        out = f"(({out}) * {step} + {d.hexint(f'substr({digest}, {8 * i + 1}, 8)')}) % {base}"
    return out
