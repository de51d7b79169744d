"""Column names that cannot clash with a caller's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_name(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores added until ``df`` has no such column (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
