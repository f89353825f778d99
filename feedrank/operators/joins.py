"""Join helpers: size-checked broadcast, salted many-to-one joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row bound under which a lookup side may be broadcast.  The check is made
# with ``limit(n + 1).count()``, which stops reading after n + 1 rows.
DEFAULT_BROADCAST_ROWS = 200_000


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (cheap early-stopping check)."""
    return df.limit(max_rows + 1).count() <= max_rows


# Narrow lookup tables (a key and a few numbers) may be broadcast up to this bound.
LOOKUP_BROADCAST_ROWS = 1_000_000


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
                max_broadcast_rows: int = LOOKUP_BROADCAST_ROWS) -> DataFrame:
    """Join a large table to a keyed lookup table (at most one row per key).

    The lookup side is broadcast only after a row-count bound is proven.
    Otherwise it is a shuffle join and a hot key on the large side is split by
    AQE's skew-join handling (enabled by ``session.DEFAULT_CONF``), which
    replicates only the matching lookup partition; see ``salted_join`` for an
    explicit alternative.
    """
    if is_bounded(small, max_broadcast_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def salted_join(big: DataFrame, small: DataFrame, on, how: str = "inner", salts: int = 16) -> DataFrame:
    """Many-to-one join with the lookup side replicated over ``salts`` and the
    large side spread by a deterministic row hash, for engines without AQE."""
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        return big.join(small, on, how)
    # Deterministic salt (a hash of the whole row) so a retried task salts alike.
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts))
    b = big.withColumn("_salt", salt.cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, keys + ["_salt"], how).drop("_salt")
