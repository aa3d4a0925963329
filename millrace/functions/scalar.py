"""Scalar functions over columns. Offsets and lengths of strings are in bytes of UTF-8."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.IntegralType, T.FractionalType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FractionalType)


def _micros_utc(x: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, taken as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)


def to_int(x: Column, t: T.DataType) -> Column:
    """Missing is 0, a float is truncated, a string must begin with a number, a time is in seconds since 1970, a duration in nanoseconds."""
    if isinstance(t, T.NullType):
        return F.lit(0).cast("long")
    if isinstance(t, T.StringType):
        out = F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    elif isinstance(t, T.TimestampNTZType):
        out = F.floor(_micros_utc(x) / 1_000_000)
    elif isinstance(t, (T.TimestampType, T.DateType)):
        out = F.unix_seconds(x.cast("timestamp"))
    elif isinstance(t, T.DayTimeIntervalType):
        out = (F.extract(F.lit("DAY"), x) * 86_400_000_000 + F.extract(F.lit("HOUR"), x) * 3_600_000_000 + F.extract(F.lit("MINUTE"), x) * 60_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")) * 1_000
    else:
        out = x.cast("long")
    return F.coalesce(out, F.lit(0).cast("long"))


def to_float(x: Column, t: T.DataType) -> Column:
    """As ``to_int``, but durations are in seconds too."""
    if isinstance(t, T.NullType):
        return F.lit(0.0)
    if isinstance(t, T.StringType):
        out = F.regexp_extract(x, r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    elif isinstance(t, T.TimestampNTZType):
        out = _micros_utc(x) / 1e6
    elif isinstance(t, (T.TimestampType, T.DateType)):
        out = F.unix_micros(x.cast("timestamp")) / 1e6
    elif isinstance(t, T.DayTimeIntervalType):
        out = to_int(x, t) / 1e9
    else:
        out = x.cast("double")
    return F.coalesce(out, F.lit(0.0))


def to_string(x: Column, t: T.DataType) -> Column:
    """Missing is the empty string. Floats have their shortest form, without ``.0`` and with a signed exponent of two digits from 1e21 and below 1e-4."""
    if isinstance(t, T.NullType):
        return F.lit("")
    if isinstance(t, T.FractionalType):
        out = float_text(x)
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ssxx") if isinstance(t, T.TimestampType) else F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit(""))


def float_text(x: Column) -> Column:
    digits = F.regexp_replace(x.cast("string"), r"\.0(?=E|$)", "")
    plain = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    size = F.abs(x)
    mantissa, power = F.regexp_extract(digits, r"^([^E]*)", 1), F.regexp_extract(digits, r"E(-?\d+)$", 1).try_cast("int")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "NaN")
        .when(x == float("inf"), "+Inf")
        .when(x == float("-inf"), "-Inf")
        .when(~digits.contains("E"), digits)
        .when((size >= 1e-4) & (size < 1e21), plain)
        .otherwise(scientific)
    )


def string_len(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def substring(x: Column, start: Column, end: Column | None = None) -> Column:
    """Bytes from ``start`` (from 0) up to ``end``, exclusive."""
    end = F.octet_length(x) if end is None else F.least(end.cast("int"), F.octet_length(x))
    return F.substr(x.cast("binary"), start.cast("int") + 1, end - start.cast("int")).cast("string")


def string_count(x: Column, part: Column) -> Column:
    """Occurrences that don't overlap; of the empty string, one more than there are characters."""
    cut = F.char_length(x) - F.char_length(F.replace(x, part, F.lit("")))
    return F.when(part == "", F.char_length(x) + 1).otherwise(F.try_divide(cut, F.char_length(part))).cast("long")


_LOOK = re.compile(r"\(\?<?[=!]|\\[1-9]")


def checked_regex(pattern: str) -> str:
    """The pattern, unless it looks around or refers back, which the language's regular expressions can't."""
    if _LOOK.search(pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern}")
    return pattern


def regexp_match(x: Column, pattern: str) -> Column:
    return x.rlike(checked_regex(pattern))


def regexp_replace(x: Column, pattern: str, template: str) -> Column:
    """``$1`` and ``${1}`` are groups; ``$1y`` is the group named ``1y``, which doesn't exist and is empty; ``$$`` is a dollar sign."""
    named = set(re.findall(r"\(\?P?<(\w+)>", pattern))
    groups = re.compile(pattern).groups if not named else 99

    def part(m: re.Match) -> str:
        if m[0] == "$$":
            return "\\$"
        if m[0] == "\\":
            return "\\\\"
        name = m[1] or m[2]
        if name.isdigit():
            return f"${name}" if int(name) <= groups else ""
        return f"${{{name}}}" if name in named else ""

    out = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\\", part, template)
    return F.regexp_replace(x, F.lit(checked_regex(pattern)), F.lit(out))


def sprintf(template: str, args: list[tuple[Column, T.DataType]]) -> Column:
    """Printf verbs; ``%v`` prints any value as ``to_string``; missing values and times are strings.

    Digits after the point are rounded half up from the shortest decimal form of a float (0.25 is 0.3 with one digit), where C rounds the exact binary value.
    """
    verbs = iter(re.findall(r"%[-+# 0]*[\d.]*[a-zA-Z%]", template))
    wanted = [v for v in verbs if v != "%%"]
    out = []
    for i, (x, t) in enumerate(args):
        verb = wanted[i][-1] if i < len(wanted) else "v"
        out.append(to_string(x, t) if verb in "vs" else x)
    return F.format_string(re.sub(r"(%[-+# 0]*[\d.]*)v", r"\1s", template), *out)


def hash64(*xs: Column) -> Column:
    """A hash that isn't negative. Stable, but not that of other engines."""
    return F.xxhash64(*xs).bitwiseAND(F.lit(2**63 - 1))


def divide(x: Column, y: Column, floats: bool) -> Column:
    """Integers are truncated towards zero; floats divided by zero are infinite or NaN."""
    if not floats:
        return F.call_function("div", x, y)
    zero = F.when(x == 0, float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(F.when(F.isnan(x), float("nan")))
    return F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))


def negated_text(x: Column) -> Column:
    """A string that sorts in descending order of ``x``: bytes complemented as hexadecimal digits, and an end mark above all digits."""
    return F.concat(F.translate(F.hex(x.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def isset(x: Column, y: Column) -> Column:
    return x.bitwiseAND(y) == y
