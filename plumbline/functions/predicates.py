"""Cell predicates as Spark SQL text: disguised nulls, formats, numbers, dates, booleans.

They take and give SQL text rather than columns, so that a wide table's expressions are parsed in a
few calls instead of being built node by node. ``col`` turns text into a column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import constants as K

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITY = r"^[+-]?(inf|infinity)\z"
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"
DAY_MONTH = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})\z"
YEAR_FIRST = r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})\z"
COMPACT = r"^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})(?:T[0-9]{6}Z?)?\z"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
NAMED_MONTH_FIRST = rf"^{MONTH}[.]? ([0-9]{{1,2}}),? ([0-9]{{4}})\z"
NAMED_DAY_FIRST = rf"^([0-9]{{1,2}})[ -]{MONTH}[.]?[ -]([0-9]{{4}})\z"
LONGEST_DATE = 40  # characters; all layouts are shorter, so longer texts meet no pattern

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string as SQL text; anything but plain ASCII is written as an escape."""
    out = []
    for ch in text:
        if ch in "\\'":
            out.append("\\" + ch)
        elif " " <= ch <= "~":
            out.append(ch)
        else:
            out.append(f"\\u{ord(ch):04x}" if ord(ch) < 0x10000 else f"\\U{ord(ch):08x}")
    return "'" + "".join(out) + "'"


def col(sql: str) -> Column:
    return F.expr(sql)


def any_of(words: list[str]) -> str:
    return "(" + ", ".join(literal(w) for w in words) + ")"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def present(c: str, dtype: T.DataType) -> str:
    """The cell with NaN turned into null, so that "missing" means one thing."""
    return f"nanvl({c}, null)" if isinstance(dtype, (T.FloatType, T.DoubleType)) else c


def missing(c: str, dtype: T.DataType) -> str:
    return f"({present(c, dtype)} is null)"


def as_double(name: str, dtype: T.DataType) -> str:
    """A numeric column as double, NaN as null."""
    return f"cast({present(quoted(name), dtype)} as double)"


def strip(c: str) -> str:
    return f"btrim({c}, {literal(K.WHITESPACE)})"


# The functions ending in _of take text that is stripped already.

def pseudo_null_of(s: str) -> str:
    return f"(lower({s}) in {any_of(K.PSEUDO_NULLS)})"


def boolean_of(s: str) -> str:
    return f"(lower({s}) in {any_of(K.BOOLEAN_TOKENS)})"


def is_pseudo_null(c: str) -> str:
    return pseudo_null_of(strip(c))


def is_boolean_text(c: str) -> str:
    return boolean_of(strip(c))


def matches(c: str, pattern: str) -> str:
    return f"({c} rlike r'{pattern}')"


def has_format(c: str, name: str) -> str:
    """True where the stripped cell has the named format (``constants.FORMATS``)."""
    return matches(strip(c), K.FORMATS[name])


def to_number(c: str) -> str:
    """Text to double, null where it is not a number."""
    return number_of(strip(c))


def number_of(s: str) -> str:
    """The pattern guards the cast: Spark alone would also read '1d' and '1f'."""
    infinite = f"if(startswith({s}, '-'), double('-infinity'), double('infinity'))"
    return f"(case when {matches(s, NUMBER)} then try_cast({s} as double) when {matches(f'lower({s})', INFINITY)} then {infinite} end)"


def to_date(c: str) -> str:
    """Text to date over a fixed list of layouts, null where none fits."""
    return date_of(strip(c))


def _ymd(y: str, m: str, d: str) -> str:
    return f"try_cast(concat_ws('-', {y}, lpad({m}, 2, '0'), lpad({d}, 2, '0')) as date)"


def _parts(s: str, pattern: str) -> list[str]:
    return [f"regexp_extract({s}, r'{pattern}', {i})" for i in (1, 2, 3)]


def _named_month(name: str) -> str:
    return f"cast((locate(substr({name}, 1, 3), '{MONTHS}') + 2) div 3 as string)"


def plain_date_of(s: str) -> str:
    """Text to date over the layouts that can be read one way only: year first (with an optional time and offset; the date
    as written), YYYYMMDD of the years 1900 to 2099, and English month names. Layouts are told apart by pattern and read with
    ``try_cast``, which returns null instead of raising.
    """
    iso = f"try_cast(regexp_extract({s}, r'^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}', 0) as date)"
    m1, d1, y1 = _parts(f"lower({s})", NAMED_MONTH_FIRST)
    d2, m2, y2 = _parts(f"lower({s})", NAMED_DAY_FIRST)
    return (
        f"(case when char_length({s}) > {LONGEST_DATE} then null when {matches(s, ISO_DATE)} then {iso} "
        f"when {matches(s, YEAR_FIRST)} then {_ymd(*_parts(s, YEAR_FIRST))} when {matches(s, COMPACT)} then {_ymd(*_parts(s, COMPACT))} "
        f"when {matches(f'lower({s})', NAMED_MONTH_FIRST)} then {_ymd(y1, _named_month(m1), d1)} "
        f"when {matches(f'lower({s})', NAMED_DAY_FIRST)} then {_ymd(y2, _named_month(m2), d2)} end)"
    )


def numeric_date_of(s: str, day_first: bool) -> str:
    """Text to date for 31/12/2023 (``day_first``) or 12/31/2023."""
    a, b, year = _parts(s, DAY_MONTH)
    return f"(case when {matches(s, DAY_MONTH)} then {_ymd(year, b, a) if day_first else _ymd(year, a, b)} end)"


def date_of(s: str) -> str:
    """Text to date over all layouts; a cell by itself reads 05/06/2024 as day first and takes either order where only one fits.

    ``datelayouts`` settles the order by the whole column.
    """
    return f"coalesce({plain_date_of(s)}, {numeric_date_of(s, True)}, {numeric_date_of(s, False)})"


def is_date_text(c: str) -> str:
    return f"({to_date(c)} is not null)"


def is_corrupt_text(c: str) -> str:
    """Holds the replacement character, the trace of bytes that were not valid UTF-8."""
    return f"contains({c}, {literal(chr(0xFFFD))})"


def is_blank(c: str) -> str:
    return f"({c} is null or {strip(c)} = '')"


def relevant(similarity: Column, threshold: float = 0.55) -> Column:
    return similarity >= threshold


# Column names: looked at on the driver, they come from the schema.

def has_word(name: str, word: str, substring: bool = False) -> bool:
    """Compound words match inside the name, plain words only as a whole part of it."""
    low = name.lower()
    if substring or "_" in word or "-" in word:
        return word in low
    return word in re.split(r"[_\-\s]+", low)


def format_of_name(name: str, substring: bool = False) -> str | None:
    for fmt, words in K.FORMAT_WORDS.items():
        if any(has_word(name, w, substring) for w in words):
            return fmt
    return None


def semantic_of_name(name: str) -> str | None:
    for kind, words in K.SEMANTIC_WORDS.items():
        if any(has_word(name, w) for w in words):
            return kind
    return None


def is_identifier_name(name: str, substring: bool = False) -> bool:
    return has_word(name, "id", substring) or name.lower().endswith("_id")
