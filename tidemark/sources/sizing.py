"""Size-checked broadcast.

A side is broadcast only when its size is known to be below a bound: the
optimizer's own statistics estimate for the plan must be under
``spark.sql.autoBroadcastJoinThreshold`` (or the given ``max_bytes``).  When
the estimate is unknown or too big the DataFrame is returned unchanged and
the planner keeps a shuffle join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BYTES = 10 * 1024 * 1024  # Spark's own
UNITS = {"": 1, "b": 1, **{u + end: 1 << 10 * n for n, u in enumerate("kmgtp", 1) for end in ("", "b", "ib")}}


def in_bytes(size: str) -> int:
    """A byte size as Spark writes it ("1m", "10MB", "64KiB", "-1")."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", str(size).lower())
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a size: {size!r}")
    return int(m[1]) * UNITS[m[2]]


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - statistics unavailable
        return None


def maybe_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    if max_bytes is None:
        max_bytes = max(in_bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(DEFAULT_MAX_BYTES))), 0)
    size = estimated_bytes(df)
    if size is not None and 0 < size <= max_bytes:
        return F.broadcast(df)
    return df
