"""String and weight expressions of the cleaning rules. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schemas import NA_STRINGS


#: White space of Unicode, and the four separators of ASCII that also count as such.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode's included. Trimming by a set of characters is slow, so only texts that begin or end with one of them are trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.substring(c, 1, 1).isin(*_SPACE) | F.substring(c, -1, 1).isin(*_SPACE), F.btrim(c, F.lit(_SPACE))).otherwise(c)


def tidy(c: Column | str) -> Column:
    return F.lower(strip(c))


def blank_to_null(c: Column | str, blank: str = "") -> Column:
    """Null where the whole value is ``blank``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == blank, None).otherwise(c)


def na_to_null(c: Column | str) -> Column:
    """Null where the whole value is one of the texts that files use for missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*NA_STRINGS), None).otherwise(c)


def weight(c: Column | str, default: float, low: float = 1.0, high: float = 10.0) -> Column:
    """A number between ``low`` and ``high``; ``default`` for null, NaN and what is no number."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.when(~F.isnan(number), number), F.lit(float(default)))))


def first_part(c: Column | str, separator: str, stripped: bool = True) -> Column:
    """What stands before the first separator."""
    part = F.split_part(c, F.lit(separator), F.lit(1))
    return strip(part) if stripped else part


def hls_hex(hue: Column, lightness: float = 0.55, saturation: float = 0.75, rounded: bool = False) -> Column:
    """``#rrggbb`` of a hue between 0 and 1; channels are truncated to whole numbers, or ``rounded``."""
    top = lightness * (1 + saturation) if lightness <= 0.5 else lightness + saturation - lightness * saturation
    low = 2 * lightness - top

    def channel(shift: float) -> Column:
        h = F.pmod(hue + shift, F.lit(1.0))
        rising = F.lit(low) + (top - low) * h * 6
        falling = F.lit(low) + (top - low) * (F.lit(2 / 3) - h) * 6
        value = F.when(h < 1 / 6, rising).when(h < 0.5, F.lit(top)).when(h < 2 / 3, falling).otherwise(F.lit(low))
        return F.rint(value * 255).cast("int") if rounded else (value * 255).cast("int")

    return F.format_string("#%02x%02x%02x", channel(1 / 3), channel(0.0), channel(-1 / 3))
