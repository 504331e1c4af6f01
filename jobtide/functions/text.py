"""Line, interval and number parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space at a line's start, and line terminators.
SPACES = ("\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000\ufeff")
TERMINATORS = ("\n", "\r", "\u2028", "\u2029")

# Milliseconds per interval unit; no unit means milliseconds.
UNIT_MS = {"w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1_000, "": 1}


def _has_terminator(text: Column) -> Column:
    found = F.contains(text, F.lit(TERMINATORS[0]))
    for t in TERMINATORS[1:]:
        found = found | F.contains(text, F.lit(t))
    return found


def _two_parts(line: Column) -> Column:
    """Text before the second bar, the whole line if it has none."""
    return F.substring_index(line, "|", 2)


def line_type(line: Column) -> Column:
    """Text between the first two bars."""
    return F.substr(_two_parts(line), F.length(line_id(line)) + 2)


def line_payload(line: Column) -> Column:
    """Text after the second bar; bars in it stay."""
    return F.substr(line, F.length(_two_parts(line)) + 2)


def is_journal_line(line: Column) -> Column:
    """Whether ``line`` is ``id|type|payload`` with id and type not empty, payload on one line."""
    # Byte lengths are at hand, so the three conditions only look for bars.
    first, two = F.octet_length(line_id(line)), F.octet_length(_two_parts(line))
    shaped = (first > 0) & (two > first + 1) & (F.octet_length(line) > two)
    # The line as a whole is free of terminators nearly always; only else look at the payload.
    return F.coalesce(
        shaped & F.when(_has_terminator(line), ~_has_terminator(line_payload(line))).otherwise(F.lit(True)),
        F.lit(False))


def strip_leading(raw: Column) -> Column:
    """``raw`` without leading white space, but never empty: the last character stays."""
    first = F.ascii(raw)
    stripped = F.ltrim(raw, F.lit(SPACES))
    return (F.when((first > 32) & (first < 128), raw)
            .when(stripped == "", F.right(raw, F.lit(1)))
            .otherwise(stripped))


def line_id(line: Column) -> Column:
    """Text before the first bar, the whole line if it has none."""
    return F.substring_index(line, "|", 1)


def interval_ms(text: Column) -> Column:
    """``29s``, ``.5s``, ``1w``, ``200``, ``1e3`` as whole milliseconds; a blank text is 0.

    NULL when it is no interval, or one of more milliseconds than a BIGINT holds.
    """
    whole = F.trim(text, F.lit(SPACES))
    scale = F.try_element_at(F.create_map(*[F.lit(x) for unit in UNIT_MS.items() for x in unit]), F.right(whole, F.lit(1)))
    amount = F.trim(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit(SPACES))  # what stands before a unit
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"  # a number in itself, so of either sign
    value = (F.when(whole == "", F.lit(0.0))
             .when(whole.rlike(plain), whole.try_cast("double"))
             .when(scale.isNotNull() & amount.rlike(r"^\d*\.?\d*$") & amount.rlike(r"\d"), amount.try_cast("double") * scale))
    return F.round(value).try_cast("long")


def leading_code(text: Column) -> Column:
    """The non-negative whole number a response starts with; NULL if there is none or no INT holds it."""
    digits = F.regexp_extract(text, r"^\s*\+?(\d+)", 1)
    zero = F.regexp_extract(text, r"^\s*-(0+)(?!\d)", 1)
    return (F.when(digits != "", digits.try_cast("int").cast("long"))
            .when(zero != "", F.lit(0).cast("long")))


def trim_text(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def tenant(type_col: Column) -> Column:
    """Client part of a job type: text before the first dash."""
    return F.substring_index(type_col, "-", 1)


def jobtype(type_col: Column) -> Column:
    """Type part of a job type: text after the first dash, NULL when there is no dash."""
    at = F.instr(type_col, "-")
    return F.when(at > 0, F.substr(type_col, at + 1))


def tenant_type(tenant_col: Column, jobtype_col: Column) -> Column:
    return F.concat(tenant_col, F.lit("-"), jobtype_col)
