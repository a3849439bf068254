"""Numeric helpers with explicit null rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(b != 0, a / b)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def count_if(condition: Column) -> Column:
    """Rows for which a condition is true; 0 over no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def digest(*parts: Column | str, salt: str = "") -> Column:
    """The md5 of the parts and a salt: four uniforms."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in parts), F.lit(salt)))


def uniform_of(md5: Column, which: int = 0) -> Column:
    """The uniform in [0, 1) of the which-th 32 bits of a digest, 0 to 3."""
    return F.conv(F.substring(md5, 8 * which + 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def uniform(*parts: Column | str, salt: str = "") -> Column:
    """A deterministic uniform in [0, 1): 32 bits of the md5 of the parts and a salt. Equal in every SQL engine."""
    return uniform_of(digest(*parts, salt=salt))
