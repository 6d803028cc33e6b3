"""Text cleaning."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends.

    Plain spaces go first, which is cheap. What is left nearly always starts and ends with a visible
    character; looking at the two tells, and only other values pay for the trim by character set.
    """
    text = F.trim(c)
    ends = (F.substring(text, 1, 1), F.substring(text, -1, 1))
    ascii_ends = ends[0].between("!", "~") & ends[1].between("!", "~")
    space_ends = ends[0].isin(*UNICODE_SPACES) | ends[1].isin(*UNICODE_SPACES)
    return F.when(~ascii_ends & space_ends, F.trim(c, F.lit(UNICODE_SPACES))).otherwise(text)


def sql_upper_trim(c: Column) -> Column:
    """Upper case without outer spaces; tabs and line ends stay, as in SQL's TRIM."""
    return F.upper(F.trim(c))


def same_text(c: Column, value: str) -> Column:
    """Equality that ignores case and trailing spaces, the usual SQL collation."""
    return F.upper(F.rtrim(c)) == value.upper()


def lookup(c: Column, mapping: Mapping[str, object]) -> Column:
    """Value map: an unknown or null key gives null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.create_map(*pairs)[c]


def bit_text(c: Column) -> Column:
    """A Yes / No text, a boolean or a bit as '1' or '0', the text form of a bit; null for blank."""
    return lookup(strip(c.cast("string")), {"Yes": "1", "No": "0", "true": "1", "false": "0", "1": "1", "0": "0"})


def aside(c: Column, change: Callable[[Column], Column]) -> Column:
    """``change(c)`` as a call out of the generated code, for what few rows need: inlined, its expressions would make the
    code of the whole stage too long to be compiled, and slow down the rows that never get there."""
    return F.when(c.isNotNull(), F.transform(F.array(c), change)[0])


def _plain_int(text: Column) -> Column:
    """The value of a text that is just how an integer is printed, else null."""
    value = text.try_cast("int")
    return F.when(value.cast("string") == text, value)


def whole_number(c: Column) -> Column:
    """An integer written as such or with a zero fraction ('60', '60.0'); null for any other text."""
    text = c.cast("string")
    return F.coalesce(_plain_int(text), aside(text, _zero_fraction))


def _zero_fraction(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?[0-9]{1,18}(\.0*)?$"), F.split_part(text, F.lit("."), F.lit(1)).try_cast("int"))


def _number(text: Column) -> Column:
    """Decimal notation only: a cast alone also takes type suffixes, as in '95d', and names of special values."""
    return F.coalesce(_plain_int(text).cast("double"), aside(text, _decimal))


def _decimal(text: Column) -> Column:
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def percent_fraction(c: Column, negative: str = "tenth") -> Column:
    """Percent text ('95', '95%', '0.4') as a fraction; null if it is no number.

    Values up to 1 count as fractions already. ``negative`` says what a negative number gives:
    ``"tenth"`` a tenth of its size, ``"null"`` null.
    """
    if negative not in ("tenth", "null"):
        raise ValueError(f"negative must be 'tenth' or 'null', not {negative!r}")
    x = _number(F.replace(c.cast("string"), F.lit("%"), F.lit("")))
    below_zero = F.abs(x) / 10 if negative == "tenth" else F.lit(None).cast("double")
    return F.when(x < 0, below_zero).when(x <= 1, x).otherwise(x / 100)
