"""Column-level data quality profile of a table that grows by loads (problem 1).

Values are generalised to character-class masks and counted per (feed, load,
column, mask); everything about a load - missing share, fit with the column's
pattern, dominant and rare masks, shares of values, divergence between loads -
is then a sum over that small table.  Rows are unpivoted and pre-aggregated in
the map stage, so the one shuffle carries (loads x columns x masks) rows whatever
the number of rows in a load; a load with a third of all rows adds no more to it
than any other.  Medians come from the mergeable quantile summary, distinct
counts from HyperLogLog, both bounded in size per load.

Defined results
    * a value is missing if it is null, blank or one of ``STAND_INS`` (any case);
      -1 is the numbers' stand-in;
    * a load without a present value has no median and no shares, so it can be
      ``missing`` but neither ``range`` nor ``mix``;
    * a feed or load that is null is a group of its own;
    * repeated rows count as often as they come; an empty table gives no rows;
    * extra columns are ignored; a column that a spec names but the table lacks
      is left out.
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from spanforge.session import cut

# Ways of writing "no value", compared in lower case without outer white space.
STAND_INS = ["", "n/a", "na", "none", "null", "nil", "nan", "-", "--", "?", "undefined", "unknown", "missing", "(null)", "<null>"]
# Numbers that stand for "no value".
NUMBER_STAND_INS = [-1]
MIX_COLUMNS = ["role", "call_type", "model", "tool_name"]

#: rank error of the quantile summary is 1 / MEDIAN_ACCURACY
MEDIAN_ACCURACY = 10_000
_EPS = 1e-9


def read_specs(specs: DataFrame, table: DataFrame) -> list[dict]:
    """The specs that name a column of ``table``; a dimension table with one row per field of the schema."""
    have = set(table.columns)
    rows = specs.where(F.col("column_name").isNotNull()).select("path", "column_name", "value_type", "value_pattern").distinct().collect()
    return sorted((r.asDict() for r in rows if r.column_name in have), key=lambda r: r["column_name"])


_BLANKS = " \t\r\n\u00a0\u2007\u202f\u3000\u200b\ufeff"


def missing(c: Column, number: bool) -> Column:
    """Whether a value is missing; never null."""
    if number:
        return F.coalesce(c.isin(NUMBER_STAND_INS) | F.isnan(c.cast("double")), F.lit(True))
    bare = F.btrim(c, F.lit(_BLANKS))
    return F.coalesce((F.length(bare) <= max(map(len, STAND_INS))) & F.lower(bare).isin(STAND_INS), F.lit(True))


#: longer values are masked by their runs
LONG_VALUE = 64


_LOWER, _UPPER, _DIGITS = (frozenset(map(ord, x)) for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
#: the signs of times, which masks keep
_KEPT = "TZ"
#: what the signs of a mask stand for; a hexadecimal mask is read as so many x
_TEXT_SIGNS = {"a": _LOWER, "A": _UPPER - frozenset(map(ord, _KEPT)), "9": _DIGITS} | {k: frozenset([ord(k)]) for k in _KEPT}
_HEX_SIGNS = {"x": frozenset(map(ord, "0123456789abcdef"))}
_HEX_UPPER_SIGNS = {"x": frozenset(map(ord, "0123456789ABCDEF"))}
#: the characters of a negated class or a dot; -1 stands for all others, of which only those that may fit are sure
_UNIVERSE = frozenset(range(32, 127)) | {-1}


def mask(c: Column) -> Column:
    """Character-class mask of a text, one sign for each character: ``a`` a lower-case letter, ``A`` a capital,
    ``9`` a digit, all else, and T and Z (as in times), as it is.

    Eight or more hexadecimal digits are ``h<length>`` (``H<length>`` in upper case), as their letters and digits
    alternate at random; texts of more than ``LONG_VALUE`` characters are ``r`` and their runs.  As every small
    letter is generalised and no mask of capitals has an H, no other mask begins with h, H or r.
    """
    plain = {chr(c): sign for sign, of in _TEXT_SIGNS.items() for c in of if chr(c) != sign}
    each = F.translate(c, "".join(plain), "".join(plain.values()))
    return (
        F.when(c.rlike("^[0-9a-f]{8,}$"), F.concat(F.lit("h"), F.length(c).cast("string")))
        .when(c.rlike("^[0-9A-F]{8,}$"), F.concat(F.lit("H"), F.length(c).cast("string")))
        .when(F.length(c) > LONG_VALUE, F.concat(F.lit("r"), F.regexp_replace(each, r"(.)\1+", "$1")))
        .otherwise(each)
    )


def number_mask(c: Column) -> Column:
    """Sign and number of digits."""
    return F.concat(F.when(c < 0, "-9x").otherwise("9x"), F.length(F.abs(c).cast("string")).cast("string"))



def on_masks(pattern: str, signs: dict[str, frozenset], surely: bool) -> str | None:
    """The pattern as one over masks: of those all of whose values fit (``surely``), or of those any of whose values can.

    A class of characters holds a sign if it holds all, or any, of the characters that the sign stands for; as a mask
    has one sign for each character, both are exact.  None for what is no plain sequence, choice or repetition.
    """
    from re import _constants as K
    from re import _parser as parser

    def members(op, arg) -> frozenset | None:
        if op is K.LITERAL:
            return frozenset([arg])
        if op is K.NOT_LITERAL:
            return _UNIVERSE - {arg}
        if op is K.ANY:
            return _UNIVERSE
        if op is K.RANGE:
            return frozenset(range(arg[0], arg[1] + 1)) if arg[1] < 65536 else None
        if op is K.CATEGORY:
            known = {K.CATEGORY_DIGIT: _DIGITS, K.CATEGORY_WORD: _LOWER | _UPPER | _DIGITS | {95}, K.CATEGORY_SPACE: frozenset(map(ord, " \t\n\r\f\v"))}
            return known.get(arg)
        if op is K.IN:
            out, negated = frozenset(), False
            for o, x in arg:
                if o is K.NEGATE:
                    negated = True
                    continue
                one = members(o, x)
                if one is None:
                    return None
                out |= one
            return _UNIVERSE - out if negated else out
        return None

    def sign_class(chars: frozenset) -> str:
        covered = frozenset().union(*signs.values())
        letters = [s for s, of in signs.items() if (of <= chars if surely else of & chars)]
        if signs is not _TEXT_SIGNS:  # masks of nothing but x
            return f"[{''.join(letters)}]" if letters else "[^\\x{0}-\\x{10ffff}]"
        letters += [chr(c) for c in sorted(chars - covered - {-1})]
        if -1 in chars and not surely:
            return "[" + "".join(f"\\x{{{ord(x):x}}}" for x in letters) + "\\x{0}-\\x{1f}\\x{7f}-\\x{10ffff}]"
        return "[" + "".join(f"\\x{{{ord(x):x}}}" for x in letters) + "]" if letters else "[^\\x{0}-\\x{10ffff}]"

    def emit(tree) -> str | None:
        out = ""
        for op, arg in tree:
            if op in (K.MAX_REPEAT, K.MIN_REPEAT):
                lo, hi, sub = arg
                one = emit(sub)
                part = None if one is None else f"(?:{one}){{{lo},{'' if hi is K.MAXREPEAT else hi}}}"
            elif op is K.SUBPATTERN:
                one = None if arg[1] or arg[2] else emit(arg[3])
                part = None if one is None else f"(?:{one})"
            elif op is K.BRANCH:
                each = [emit(t) for t in arg[1]]
                part = None if None in each else f"(?:{'|'.join(each)})"
            else:
                chars = members(op, arg)
                part = None if chars is None else sign_class(chars)
            if part is None:
                return None
            out += part
        return out

    try:
        body = emit(parser.parse(pattern))
    except (re.error, RecursionError):
        return None
    return None if body is None else f"\\A(?:{body})\\z"


class Verdict(NamedTuple):
    """Expressions over masks: whether all their values fit a pattern, and whether none does."""

    fits: Column
    misfits: Column

    @property
    def open(self) -> Column:
        return ~self.fits & ~self.misfits


def verdict(m: Column, pattern: str | None) -> Verdict:
    """What a mask says about the fit of its values with ``pattern``; masks that say nothing are open."""
    no = F.lit(False)
    if pattern is None:
        return Verdict(F.lit(True), no)
    fits, cannot = no, no
    spelled = F.repeat(F.lit("x"), F.when(F.left(m, F.lit(1)).isin("h", "H"), F.substring(m, 2, 9).try_cast("int")))
    for own, text, signs in ((m.startswith("h"), spelled, _HEX_SIGNS), (m.startswith("H"), spelled, _HEX_UPPER_SIGNS), (~F.left(m, F.lit(1)).isin("h", "H", "r"), m, _TEXT_SIGNS)):
        sure, may = on_masks(pattern, signs, True), on_masks(pattern, signs, False)
        if sure is not None:
            fits = fits | (own & text.rlike(sure))
            cannot = cannot | (own & ~text.rlike(may))
    return Verdict(F.coalesce(fits, no), F.coalesce(cannot, no))


def mask_counts(table: DataFrame, specs: list[dict]) -> DataFrame:
    """Counts per (feed, load_id, column_name, mask, value_key), from one scan.

    ``value_key`` is the value in the mix columns and null elsewhere; ``mask`` is
    null for missing values.  Columns n and n_bad (values off the pattern): the
    mask decides where it can; values of the others are compared one by one, in
    the mix columns after their equal values were counted.
    """
    none = F.lit(None).cast("string")
    cells, masked = [], []
    for i, s in enumerate(specs):
        c, number, mix = F.col(s["column_name"]), s["value_type"] == "number", s["column_name"] in MIX_COLUMNS
        there = ~missing(c, number)
        if not mix:
            masked.append(F.when(there, number_mask(c) if number else mask(c)).alias(f"_m{i}"))
        off = F.lit(None).cast("int")
        if not mix and s["value_pattern"] is not None:
            off = F.when(verdict(F.col(f"_m{i}"), s["value_pattern"]).open, (~_fits(c, s["value_pattern"])).cast("int"))
        cells.append(F.struct(F.lit(s["column_name"]).alias("column_name"), (none if mix else F.col(f"_m{i}")).alias("mask"), (F.when(there, c.cast("string")) if mix else none).alias("value_key"), off.alias("off")))
    if not cells:
        return table.sparkSession.createDataFrame([], "feed string, load_id bigint, column_name string, mask string, value_key string, n bigint, n_bad bigint")
    names = [s["column_name"] for s in specs]
    flat = table.select("feed", "load_id", *dict.fromkeys(names), *masked).select("feed", "load_id", F.inline(F.array(*cells)))
    counted = flat.groupBy("feed", "load_id", "column_name", "mask", "value_key").agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("off"))
    shown, bad = F.coalesce("mask", mask(F.col("value_key"))), F.lit(0)
    counted = counted.withColumn("mask", shown)
    for s in specs:
        if s["value_pattern"] is not None:
            says = verdict(F.col("mask"), s["value_pattern"])
            alone = F.when(~_fits(F.col("value_key"), s["value_pattern"]), F.col("n")).otherwise(0) if s["column_name"] in MIX_COLUMNS else F.coalesce("off", F.lit(0))
            own = F.when(says.fits, 0).when(says.misfits, F.col("n")).otherwise(alone)
            bad = F.when((F.col("column_name") == s["column_name"]) & F.col("mask").isNotNull(), own).otherwise(bad)
    return counted.select("feed", "load_id", "column_name", "mask", "value_key", "n", bad.cast("bigint").alias("n_bad"))


def _fits(c: Column, pattern: str) -> Column:
    return F.coalesce(c.cast("string").rlike(f"\\A(?:{pattern})\\z"), F.lit(False))


def load_ranges(table: DataFrame, specs: list[dict]) -> DataFrame:
    """Smallest, largest and median value per (feed, load_id, column_name), one row each."""
    if not specs:
        return table.sparkSession.createDataFrame([], "feed string, load_id bigint, column_name string, min_value string, max_value string, median_value double")
    aggs, cells = [], []
    for i, s in enumerate(specs):
        c, number = F.col(s["column_name"]), s["value_type"] == "number"
        there = F.when(~missing(c, number), c if number else c.cast("string"))
        aggs += [F.min(there).alias(f"lo{i}"), F.max(there).alias(f"hi{i}")]
        aggs.append(F.percentile_approx(there, 0.5, MEDIAN_ACCURACY).cast("double").alias(f"m{i}") if number else F.any_value(F.lit(None).cast("double")).alias(f"m{i}"))
        cells.append(F.struct(F.lit(s["column_name"]).alias("column_name"), F.col(f"lo{i}").cast("string").alias("min_value"), F.col(f"hi{i}").cast("string").alias("max_value"), F.col(f"m{i}").alias("median_value")))
    return table.groupBy("feed", "load_id").agg(*aggs).select("feed", "load_id", F.inline(F.array(*cells)))


def load_distincts(table: DataFrame, specs: DataFrame) -> DataFrame:
    """Estimated number of different present values per (feed, load_id, column_name); HyperLogLog, so fixed in size for each load."""
    spec = read_specs(specs, table)
    if not spec:
        return table.sparkSession.createDataFrame([], "feed string, load_id bigint, column_name string, n_distinct bigint")
    table = table.withColumn("feed", F.coalesce("feed", F.lit("")))
    aggs = [F.approx_count_distinct(F.when(~missing(F.col(s["column_name"]), s["value_type"] == "number"), F.col(s["column_name"]))).alias(f"d{i}") for i, s in enumerate(spec)]
    cells = [F.struct(F.lit(s["column_name"]).alias("column_name"), F.col(f"d{i}").alias("n_distinct")) for i, s in enumerate(spec)]
    return table.groupBy("feed", "load_id").agg(*aggs).select("feed", "load_id", F.inline(F.array(*cells)))


def medians(table: DataFrame, specs: list[dict]) -> DataFrame:
    """Median of the present values per (feed, load_id, column_name) of the numeric columns."""
    nums = [s for s in specs if s["value_type"] == "number"]
    if not nums:
        return table.sparkSession.createDataFrame([], "feed string, load_id bigint, column_name string, median_value double")
    aggs = [F.percentile_approx(F.when(~missing(F.col(s["column_name"]), True), F.col(s["column_name"])), 0.5, MEDIAN_ACCURACY).cast("double").alias(f"m{i}") for i, s in enumerate(nums)]
    cells = [F.struct(F.lit(s["column_name"]).alias("column_name"), F.col(f"m{i}").alias("median_value")) for i, s in enumerate(nums)]
    return table.groupBy("feed", "load_id").agg(*aggs).select("feed", "load_id", F.inline(F.array(*cells)))


def latest_reports(checks: DataFrame, specs: list[dict]) -> DataFrame:
    """The latest report of each load and column; ties go to the highest check_id."""
    names = T.StructType([T.StructField("path", T.StringType()), T.StructField("column_name", T.StringType())])
    dim = checks.sparkSession.createDataFrame([(s["path"], s["column_name"]) for s in specs], names)
    last = F.max_by(F.struct("population_rate"), F.struct(F.coalesce(F.col("reported_at"), F.lit("1900-01-01").cast("timestamp_ntz").cast(checks.schema["reported_at"].dataType)).alias("t"), F.col("check_id")))
    own = checks.select("check_id", "load_id", "path", "population_rate", "reported_at")
    return own.join(F.broadcast(dim), "path").groupBy("load_id", "column_name").agg(last.alias("r")).select("load_id", "column_name", F.col("r.population_rate").alias("reported_rate"))


#: a mask of this share of the values in a feed's first load is a dominant pattern of its column
DOMINANT = 0.05


def mined(masks: DataFrame) -> DataFrame:
    """Counts per (feed, load_id, column_name, mask) of present values with ``is_rare``: the mask is not dominant in the feed's first load.

    The first load is the lowest load_id of the feed that has a present value in the column.
    """
    m = masks.where(F.col("mask").isNotNull()).groupBy("feed", "load_id", "column_name", "mask").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    m = m.withColumn("share", F.col("n") / F.sum("n").over(W.Window.partitionBy("feed", "load_id", "column_name")))
    m = m.withColumn("first_load", F.min("load_id").over(W.Window.partitionBy("feed", "column_name")))
    in_first = F.max(F.when(F.col("load_id").eqNullSafe(F.col("first_load")), F.col("share"))).over(W.Window.partitionBy("feed", "column_name", "mask"))
    m = m.withColumn("first_share", F.coalesce(in_first, F.lit(0.0)))
    return m.select("feed", "load_id", "column_name", "mask", "n", "n_bad", "share", "first_share", (F.col("first_share") < DOMINANT - _EPS).alias("is_rare"))


def profile(masks: DataFrame) -> DataFrame:
    """One row per (feed, load_id, column_name): rows, missing values and values off the pattern."""
    return masks.groupBy("feed", "load_id", "column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("mask").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.sum("n_bad").alias("n_bad")
    )


def with_first(per_load: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``first_<col>``: the values of the feed's first load (lowest load_id)."""
    w = W.Window.partitionBy("feed", "column_name").orderBy(F.col("load_id").asc_nulls_last())
    out = per_load
    for c in cols:
        out = out.withColumn(f"first_{c}", F.first(c).over(w))
    return out.withColumn("is_first", F.row_number().over(w) == 1)


def divergence(masks: DataFrame, what: str) -> DataFrame:
    """Half the sum of absolute differences of the shares of ``what`` (``mask`` or
    ``value_key``) between each load and its feed's first load.

    Loads or first loads without a present value give null.  Columns feed,
    load_id, column_name, distance.
    """
    there = masks.where(F.col("mask").isNotNull() & F.col(what).isNotNull()).groupBy("feed", "load_id", "column_name", what).agg(F.sum("n").alias("n"))
    w = W.Window.partitionBy("feed", "load_id", "column_name")
    shares = there.withColumn("share", F.col("n") / F.sum("n").over(w))
    loads = masks.groupBy("feed", "load_id", "column_name").agg(F.lit(1).alias("one"))
    w1 = W.Window.partitionBy("feed", "column_name")
    loads = loads.withColumn("first_load", F.min("load_id").over(w1)).where(F.col("load_id") != F.col("first_load")).drop("one")
    first = shares.join(loads.select("feed", "column_name", F.col("first_load").alias("load_id")).distinct(), ["feed", "load_id", "column_name"], "left_semi")
    first = first.select("feed", "column_name", what, F.col("share").alias("first_share"))
    # sum |a-b| over the values of either = sum over own values of |a-b| + (1 - first's share on own values)
    own = (
        loads.join(shares, ["feed", "load_id", "column_name"])
        .join(first, ["feed", "column_name", what], "left")
        .groupBy("feed", "load_id", "column_name")
        .agg(F.sum(F.abs(F.col("share") - F.coalesce("first_share", F.lit(0.0)))).alias("d"), F.sum(F.coalesce("first_share", F.lit(0.0))).alias("covered"))
    )
    has_first = first.groupBy("feed", "column_name").agg(F.lit(True).alias("has_first"))
    return own.join(has_first, ["feed", "column_name"]).select("feed", "load_id", "column_name", ((F.col("d") + 1 - F.col("covered")) / 2).alias("distance"))


def issues(table: DataFrame, specs: DataFrame, checks: DataFrame) -> DataFrame:
    """Every issue of every load: (load_id, column_name, issue), one row each."""
    spec = read_specs(specs, table)
    table = table.withColumn("feed", F.coalesce("feed", F.lit(""))) if "feed" in table.columns else table.withColumn("feed", F.lit(""))
    masks = cut(mask_counts(table, spec))
    per_load = profile(masks)
    per_load = per_load.join(medians(table, spec), ["feed", "load_id", "column_name"], "left").join(divergence(masks.where(F.col("column_name").isin(MIX_COLUMNS)), "value_key"), ["feed", "load_id", "column_name"], "left")
    per_load = per_load.join(latest_reports(checks, spec), ["load_id", "column_name"], "left")
    per_load = per_load.withColumn("missing_share", F.col("n_missing") / F.col("n_rows"))
    p = with_first(per_load, ["missing_share", "median_value"])
    present = F.col("n_rows") - F.col("n_missing")
    found = {
        "missing": ~F.col("is_first") & (F.abs(F.col("missing_share") - F.col("first_missing_share")) >= 0.15 - _EPS),
        "pattern": (present > 0) & (F.col("n_bad") / F.nullif(present, F.lit(0)) >= 0.05 - _EPS),
        "range": ~F.col("is_first")
        & (((F.col("median_value") >= 3 * F.col("first_median_value")) | (F.col("median_value") <= F.col("first_median_value") / 3)) & (F.col("first_median_value") > 0)),
        "mix": ~F.col("is_first") & (F.col("distance") >= 0.2 - _EPS),
        "report": F.abs(F.col("reported_rate") - (1 - F.col("missing_share"))) > 0.02 + _EPS,
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in found.items()]))
    return p.select("load_id", "column_name", F.explode(names).alias("issue")).distinct()


def mask_report(table: DataFrame, specs: DataFrame) -> DataFrame:
    """Masks per load and column with their share, the share in the feed's first load and whether they break the
    column's dominant patterns there (rare-mask violations)."""
    spec = read_specs(specs, table)
    return mined(mask_counts(table.withColumn("feed", F.coalesce("feed", F.lit(""))), spec))


def load_profile(table: DataFrame, specs: DataFrame) -> DataFrame:
    """The profile itself: one row per feed, load and column.

    ``top_mask`` is the most frequent mask (ties: the last by name), ``rare_mask_share`` the share of present values
    that break the dominant masks of the feed's first load, ``mask_divergence`` half the sum of the absolute
    differences between the two loads' shares of masks.
    """
    spec = read_specs(specs, table)
    table = table.withColumn("feed", F.coalesce("feed", F.lit("")))
    key = ["feed", "load_id", "column_name"]
    masks = cut(mask_counts(table, spec))
    top = mined(masks).groupBy(*key).agg(
        F.max_by("mask", F.struct("n", "mask")).alias("top_mask"), (F.sum(F.when(F.col("is_rare"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rare_mask_share")
    )
    out = profile(masks).join(load_ranges(table, spec), key, "left").join(top, key, "left")
    out = out.join(divergence(masks, "mask").withColumnRenamed("distance", "mask_divergence"), key, "left")
    return out.withColumn("missing_share", F.col("n_missing") / F.col("n_rows"))
