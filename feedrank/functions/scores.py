"""Score parsing for model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_score(reply) -> Column:
    """Parse a reply as a number and clamp it to [0, 1]; unparsable -> 0.0.

    NaN and +inf clamp to 1.0, -inf to 0.0, as ``max(0, min(1, float(t)))``.
    """
    v = _try_double(strip_ws(reply))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0))))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")
