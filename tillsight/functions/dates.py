"""Date parsing and calendar parts.

A text date is parsed by its own shape: year first, numbers only, a month's
name before or after the day, or eight digits; each with an optional time of
day, AM or PM, and a zone, which is brought to UTC.  A shape's pattern turns
the value into one row of parts, so every value is parsed once and nothing is
tried in vain.  Only the order of day and month in an all-number date is
open: one aggregate per dataset decides it from all values (a first number
above 12 speaks for day first, a second one above 12 for month first; month
first if neither prevails).  Single formats and lists of formats can still
be given; then a list's format is chosen per dataset by counting what each
candidate parses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, cut_lineage

# Datasets (files) whose format choice is broadcast; beyond, a shuffle join.
MAX_DATASETS_BROADCAST = 1_000_000

# Candidate date formats in priority order (Spark patterns).
# ISO forms first; month-first before day-first, as US-style exports are the
# common case for sales files.
DATE_FORMATS = (
    "yyyy-MM-dd[[ ]['T']HH:mm[:ss][.SSSSSS][.SSS]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy[ H:mm[:ss]]",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d-MMM-yyyy",
)


# A prefix every string a candidate accepts must start with
# (same order as DATE_FORMATS).  A parse is only attempted behind its
# guard; failed parses are costly, the regular expression test is not.
FORMAT_GUARDS = (
    r"^\d{4,}-\d+-\d+",
    r"^\d{4,}/\d+/\d+",
    r"^\d+/\d+/\d{4,}",
    r"^\d+/\d+/\d{4,}",
    r"^\d+-\d+-\d{4,}",
    r"^\d+-\d+-\d{4,}",
    r"^\d+\.\d+\.\d{4,}",
    r"^\d{8}",
    r"^\d+\s+\S+\s+\d{4,}",
    r"^\S+\s+\d+,\s*\d{4,}",
    r"^\d+-\S+-\d{4,}",
)


# A time of day behind a date, and the shapes of dates.  Fixed values: spellings that exports use.
_TIME = r"(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?)?$"
_YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME
_EIGHT = r"^(\d{4})(\d{2})(\d{2})" + _TIME
_NUMBERS = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TIME
_DAY_NAME = r"^(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4}|\d{2})" + _TIME
_NAME_DAY = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TIME
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _parts(text: Column) -> Column:
    """``[order, first, second, third, hour, minute, second, fraction, half, zone]`` of a date text, by its shape; NULL for others.

    ``order`` names the three: ``ymd``, ``dmy``, ``mdy``, or ``?`` where day and month are open.
    """
    def row(pattern: str, head: str, first: int) -> Column:
        times = "|".join(f"${i}" for i in range(first, first + 6))
        return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{head}|{times}")), r"\|")

    out = F.when(text.rlike(r"^\d{4}[-/.]") & text.rlike(_YEAR_FIRST), row(_YEAR_FIRST, "ymd|$1|$3|$4", 5))
    out = out.when(text.rlike(r"^\d{1,2}\.") & text.rlike(_NUMBERS), row(_NUMBERS, "dmy|$1|$3|$4", 5))
    out = out.when(text.rlike(r"^\d{1,2}[-/]\d") & text.rlike(_NUMBERS), row(_NUMBERS, "?|$1|$3|$4", 5))
    out = out.when(text.rlike(r"^\d{8}") & text.rlike(_EIGHT), row(_EIGHT, "ymd|$1|$2|$3", 4))
    out = out.when(text.rlike(r"^\d{1,2}") & text.rlike(_DAY_NAME), row(_DAY_NAME, "dmy|$1|$2|$3", 4))
    return out.when(text.rlike(r"^[A-Za-z]") & text.rlike(_NAME_DAY), row(_NAME_DAY, "mdy|$1|$2|$3", 4))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _month(text: Column) -> Column:
    """A month's number, from its digits or a beginning of its name of three letters or more."""
    names = F.array(*map(F.lit, _MONTHS))
    by_name = F.array_position(F.transform(names, lambda m: F.startswith(m, F.lower(text))), F.lit(True)).cast("int")
    return F.when(text.rlike(r"^\d"), text.try_cast("int")).otherwise(F.nullif(by_name, F.lit(0)))


def parse_shape(c: Column | str, day_first: Column | bool = False) -> Column:
    """Text -> TIMESTAMP (UTC) by the value's own shape; NULL where no shape fits or no such day or time exists."""
    first = day_first if isinstance(day_first, Column) else F.lit(day_first)

    def build(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        number = lambda x: F.coalesce(F.nullif(x, F.lit("")).try_cast("int"), F.lit(0))
        order = F.when(at(0) == "?", F.when(first, F.lit("dmy")).otherwise(F.lit("mdy"))).otherwise(at(0))
        year = F.when(order == "ymd", at(1)).otherwise(at(3))
        month = _month(F.when(order == "mdy", at(1)).otherwise(at(2)))
        day = F.when(order == "ymd", at(3)).when(order == "dmy", at(1)).otherwise(at(2)).try_cast("int")
        y = year.try_cast("int")
        y = F.when(F.length(year) > 2, y).when(y < 69, y + 2000).otherwise(y + 1900)
        half = F.lower(at(8))
        clock = number(at(4))
        hour = F.when(half == "", clock).when((clock >= 1) & (clock <= 12), clock % 12 + F.when(half == "pm", 12).otherwise(0))
        seconds = F.concat(number(at(6)).cast("string"), F.lit("."), F.rpad(F.substring(at(7), 1, 6), 6, "0")).try_cast("decimal(8,6)")
        zone = F.regexp_replace(at(9), ":", "")
        minutes = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int")
                         * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))).otherwise(F.lit(0))
        ts = F.try_make_timestamp(y, month, day, hour, number(at(5)), seconds)
        return F.timestamp_micros(F.unix_micros(ts) - minutes.cast("long") * 60_000_000)

    return _let(F.trim(_col(c).cast("string")), lambda t: _let(_parts(t), build))


def day_first_votes(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., day_first)``: the order of day and month that the keys' all-number dates show."""
    text = F.trim(F.col(column).cast("string"))
    pair = F.when(text.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]"), F.split(text, "[-/]"))
    a, b = F.get(pair, F.lit(0)).try_cast("int"), F.get(pair, F.lit(1)).try_cast("int")
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg((F.count_if((a > 12) & (b <= 12)) > F.count_if((b > 12) & (a <= 12))).alias("day_first"))


def _guard(fmt: str, formats: Sequence[str]) -> str | None:
    if tuple(formats) == DATE_FORMATS:
        return FORMAT_GUARDS[DATE_FORMATS.index(fmt)]
    return None


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_with(c: Column | str, fmt: str, guard: str | None = None) -> Column:
    """Text -> TIMESTAMP with one pattern; NULL when it does not match."""
    col = F.trim(_col(c).cast("string"))
    parsed = F.try_to_timestamp(col, F.lit(fmt))
    return parsed if guard is None else F.when(col.rlike(guard), parsed)


def format_scores(df: DataFrame, column: str, keys: Sequence[str] = (),
                  formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """One row per key: how many values each candidate format parses.

    Candidates are tried on each *distinct* value once, weighted by how
    often it occurs (a partial aggregate first), not on every row.
    """
    vals = (df.groupBy(*keys, F.trim(F.col(column).cast("string")).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n")))
    aggs = [F.sum(F.when(parse_with("_v", f, _guard(f, formats)).isNotNull(), F.col("_n"))
                  .otherwise(F.lit(0))).alias(f"f{i}") for i, f in enumerate(formats)]
    grouped = vals.groupBy(*keys) if keys else vals.groupBy()
    scored = grouped.agg(*aggs)
    # Best index: highest count, earliest candidate on ties.  Encode as
    # count * n - index so one max() gives both.
    n = len(formats)
    enc = F.greatest(*[F.col(f"f{i}") * F.lit(n) + F.lit(n - 1 - i) for i in range(n)])
    best = F.lit(n - 1) - (enc % F.lit(n))
    return scored.select(*keys, best.cast("int").alias("date_format_idx"))


def parse_chosen(c: Column | str, idx: Column,
                 formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Parse with the format at position ``idx`` of ``formats``."""
    expr = None
    for i, f in enumerate(formats):
        p = parse_with(c, f, _guard(f, formats))
        expr = F.when(idx == i, p) if expr is None else expr.when(idx == i, p)
    return expr


def parse_dates(df: DataFrame, column: str, out: str = "order_date",
                keys: Sequence[str] = (), fmt: str | None = None,
                formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Add ``out`` = ``column`` parsed as TIMESTAMP.

    With ``fmt`` the pattern is used as given; with other ``formats`` the best
    candidate is chosen per ``keys`` group in one aggregate.  Otherwise every
    value is parsed by its shape, and only the order of day and month comes
    from the aggregate.  The small choice table is joined back on the keys.
    """
    if fmt is not None:
        return df.withColumn(out, parse_with(column, fmt, _guard(fmt, formats) if fmt in formats else None))
    by_shape = tuple(formats) == DATE_FORMATS
    choice = day_first_votes(df, column, keys) if by_shape else format_scores(df, column, keys, formats)
    parsed = parse_shape(column, F.coalesce("day_first", F.lit(False))) if by_shape else parse_chosen(column, F.col("date_format_idx"), formats)
    if keys:
        # One row per dataset, but the planner cannot know that: without a
        # proven bound it would shuffle every row by dataset (a few huge
        # partitions).  Materialise the choice, prove the bound, broadcast.
        choice = broadcast_if_bounded(cut_lineage(choice), MAX_DATASETS_BROADCAST)
        joined = df.join(choice, list(keys), "left")
    else:
        joined = df.crossJoin(F.broadcast(choice))
    return joined.withColumn(out, parsed).drop(*[c for c in choice.columns if c not in keys])


def month_label(ts: Column | str) -> Column:
    """'yyyy-MM' of a timestamp."""
    return F.date_format(_col(ts), "yyyy-MM")


def week_start(ts: Column | str) -> Column:
    """Monday of the ISO week, as DATE (time of day removed)."""
    return F.to_date(F.date_trunc("week", _col(ts)))
