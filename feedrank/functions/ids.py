"""Identifier expressions: id tails, safe names, config hashes, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's output format.
ABS_LINK_BASE = "https://arxiv.org/abs/"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def id_tail(c) -> Column:
    """Last path segment (``.../abs/2305.15334v1`` -> ``2305.15334v1``)."""
    return F.substring_index(_c(c), "/", -1)


def file_safe_id(c) -> Column:
    return F.translate(_c(c), "/", "_")


def html_safe_id(c) -> Column:
    return F.translate(_c(c), "./", "-_")


def model_key(c) -> Column:
    return F.translate(_c(c), "/:", "--")


def config_hash(model, lang) -> Column:
    """First 8 hex digits of md5(``model-lang``)."""
    return F.substring(F.md5(F.concat_ws("-", _c(model), _c(lang))), 1, 8)


def abs_link(paper_id) -> Column:
    return F.concat(F.lit(ABS_LINK_BASE), _c(paper_id).cast("string"))
