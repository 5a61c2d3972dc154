"""Row-level expressions. Each returns a ``Column`` and stays inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from stockaudit import fixed_values as fixed


def address_part(address: Column, part: str) -> Column:
    """One fixed-position part of an address; past the end gives ``''``, null stays null."""
    first, last = fixed.ADDRESS_PARTS[part]
    return F.substring(address, first, last - first + 1)


def parse_number(text: Column) -> Column:
    """Text as a double, null where it is not a number."""
    return text.try_cast("double")


def parse_address(
    df: DataFrame,
    address: str = "address_id",
    parts: Sequence[str] = tuple(fixed.ADDRESS_PARTS),
    numeric_floor: bool = False,
) -> DataFrame:
    """Add the named address parts as columns; the floor optionally as a number."""
    columns = {part: address_part(F.col(address), part) for part in parts}
    if numeric_floor and "floor" in columns:
        columns["floor"] = parse_number(columns["floor"])
    return df.withColumns(columns)


def market_of(
    site: Column,
    prefixes: Mapping[str, str] = fixed.MARKET_PREFIXES,
    default: str = fixed.MARKET_DEFAULT,
) -> Column:
    """Market of a site by code prefix. A null site falls to the default."""
    rules = list(prefixes.items())
    chain = F.when(site.startswith(rules[0][0]), rules[0][1])
    for prefix, market in rules[1:]:
        chain = chain.when(site.startswith(prefix), market)
    return chain.otherwise(default)


def in_market(
    site: Column,
    market: str,
    prefixes: Mapping[str, str] = fixed.MARKET_PREFIXES,
    default: str = fixed.MARKET_DEFAULT,
) -> Column:
    """``market_of(site) == market`` as prefix tests, which a Parquet scan can evaluate.

    Prefixes must not overlap.
    """
    wanted = [prefix for prefix, name in prefixes.items() if name == market]
    if market != default:
        condition = F.lit(False)
        for prefix in wanted:
            condition = site.startswith(prefix) if prefix == wanted[0] else condition | site.startswith(prefix)
        return condition
    condition = F.lit(True)
    for prefix, name in prefixes.items():
        if name != default:
            condition = condition & ~site.startswith(prefix)
    return site.isNull() | condition


def flag(condition: Column, yes, no) -> Column:
    """``yes`` or ``no`` by a condition, null where the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def divergence(counted: Column, system: Column) -> Column:
    return counted - system


def divergence_type(difference: Column) -> Column:
    """Found for a surplus, Lost for a shortage, ok for a match, null when not counted."""
    return F.when(difference == 0, fixed.OK).when(difference > 0, fixed.FOUND).when(difference < 0, fixed.LOST)


def density_bucket(density: Column, edge: int) -> Column:
    """``ge`` at or above the edge, ``lt`` below it."""
    return flag(density >= edge, "ge", "lt")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return F.try_divide(numerator, denominator)


def pct_label(value: Column, digits: int) -> Column:
    """``0.0625`` as ``6.2%``: half-even at the given digits, null for null."""
    text = F.format_string(f"%.{digits}f%%", F.bround(value * 100, digits))
    return F.when(value.isNotNull(), text)


def first_word(text: Column) -> Column:
    """The leading run of non-space characters, null where there is none."""
    return F.regexp_substr(text, F.lit(fixed.FIRST_WORD))


def _full_year(year: Column) -> Column:
    """A year of two digits in full: up to ``LAST_SHORT_YEAR`` of this century, the others of the last."""
    short = F.when(year.try_cast("int") <= fixed.LAST_SHORT_YEAR, F.concat(F.lit("20"), year))
    return F.when(F.length(year) == 2, F.coalesce(short, F.concat(F.lit("19"), year))).otherwise(year)


def _iso_day(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """``y-m-d`` from the groups of a pattern; parts that are no date fail when cast."""
    part = [F.regexp_extract(text, pattern, group) for group in (year, month, day)]
    return F.concat_ws("-", _full_year(part[0]), *[F.lpad(p, 2, "0") for p in part[1:]])


def parse_date(text: Column) -> Column:
    """Year, month and day as a date, null where they do not parse.

    ``yyyy-MM-dd`` is parsed as it is. Other separators, one-digit parts, years of two digits and parts
    written without a separator are taken by the looser patterns.
    """
    loose = F.coalesce(*[_iso_day(text, pattern, 1, 2, 3).try_cast("date") for pattern in fixed.LOOSE_DATES])
    return F.coalesce(F.try_to_date(text, fixed.DATE_FORMAT), loose)


def parse_timestamp(text: Column) -> Column:
    """Day, month, year and time as a zone-free timestamp, null where they do not parse.

    ``TIMESTAMP_FORMAT`` is re-ordered and cast rather than parsed with the session's zone, in which some
    wall-clock times do not exist; looser forms are taken as in ``parse_date``.
    """
    iso = F.concat(
        F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2),
        F.substring(text, 11, 9),
    )
    strict = F.when(
        (F.length(text) == len(fixed.TIMESTAMP_FORMAT)) & text.rlike(fixed.STRICT_TIMESTAMP), iso.try_cast("timestamp_ntz")
    )
    loose = []
    for pattern in fixed.LOOSE_TIMESTAMPS:
        clock = F.concat_ws(":", *[F.lpad(F.regexp_extract(text, pattern, group), 2, "0") for group in (4, 5, 6)])
        loose.append(F.concat_ws(" ", _iso_day(text, pattern, 3, 2, 1), clock).try_cast("timestamp_ntz"))
    return F.coalesce(strict, *loose)


def month_label(month: Column, labels: Sequence[str] = fixed.MONTH_LABELS) -> Column:
    """Label of a month number, null for null."""
    return F.elt(month, *[F.lit(label) for label in labels])


def label(template: str, **values: Column | str) -> Column:
    """A label template with its ``{fields}`` filled; null as soon as one value is null."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            value = values[field]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)
