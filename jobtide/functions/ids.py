"""The base-64 id codec as column expressions.

An id is ``ts7 + '-' + sysid + '-' + seq3``: seven digits of epoch milliseconds, the owner, and
three digits of an 18-bit sequence. Digits are in ASCII order, so equal-width encodings sort like
numbers and ids of one owner sort by creation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The digits, in order, and the widths of an id's parts.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~"
TIME_WIDTH = 7
SEQ_WIDTH = 3
SEQ_LIMIT = 64 ** SEQ_WIDTH

# The digits that standard base 64 uses for the same values.
_STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

# Longest digit run that is still a time; anything longer is past the range of dates.
MAX_DECODE = 8


def encode64(value: Column, width: int) -> Column:
    """``value`` (bigint) as exactly ``width`` digits."""
    digits = F.array(*[F.lit(c) for c in DIGITS])
    return F.concat(*[
        F.element_at(digits, (F.shiftright(value, 6 * i).bitwiseAND(F.lit(63)) + 1).cast("int"))
        for i in range(width - 1, -1, -1)
    ])


def decode64(text: Column) -> Column:
    """The number in the leading digits of ``text``; 0 without any, NULL when out of range."""
    return F.coalesce(_decode_time(text), _decode_any(text))


def _decode_time(text: Column) -> Column:
    """The usual case, a time of full width before a dash: a sum of table look-ups, else NULL."""
    values = [DIGITS.find(chr(c)) for c in range(128)]
    table = F.array(*[F.lit(v if v >= 0 else None).cast("long") for v in values])
    places = [F.shiftleft(F.get(table, F.ascii(F.substring(text, i + 1, 1))),
                          6 * (TIME_WIDTH - 1 - i)) for i in range(TIME_WIDTH)]
    return F.when(F.substring(text, TIME_WIDTH + 1, 1) == "-", reduce(lambda a, b: a + b, places))


def _decode_any(text: Column) -> Column:
    # One chain in which every step uses its input once, so the cost does not rest on common
    # subexpressions being shared: digits to standard base 64, to six bytes, to a number.
    digits = F.lpad(F.regexp_extract(text, "^[0-9A-Z_a-z~]*", 0), MAX_DECODE, DIGITS[0])
    octets = F.hex(F.unbase64(F.translate(digits, DIGITS, _STANDARD)))
    return F.when(~text.rlike(f"^[0-9A-Z_a-z~]{{{MAX_DECODE + 1}}}"),
                  F.conv(octets, 16, 10).cast("long"))


def created_ms(id_col: Column) -> Column:
    """Creation time of a job, in epoch milliseconds, read from its id."""
    return decode64(id_col)


def created_at(id_col: Column) -> Column:
    return F.timestamp_millis(decode64(id_col))


def created_day(id_col: Column) -> Column:
    """The UTC day of a job's creation; NULL for an id that tells no time."""
    return F.date_from_unix_date(F.floor(decode64(id_col) / 86_400_000).cast("int"))


def make_id(ms: Column, sysid: Column, seq: Column) -> Column:
    return F.concat(encode64(ms, TIME_WIDTH), F.lit("-"), sysid, F.lit("-"),
                    encode64(seq, SEQ_WIDTH))


def numbered_id(n: Column, sysid: Column, base_ms: int) -> Column:
    """Id number ``n`` (0-based) of a run of ids that starts at ``base_ms``."""
    n = n.cast("long")
    ms = F.lit(base_ms).cast("long") + F.shiftright(n, 6 * SEQ_WIDTH)
    return make_id(ms, sysid, n.bitwiseAND(F.lit(SEQ_LIMIT - 1)))
