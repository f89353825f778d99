"""Tokenisation shared by the native (model-free) scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token rule: lower-cased runs of letters; everything else separates.
TOKEN_SPLIT = r"[^\p{L}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), TOKEN_SPLIT), lambda t: t != "")
