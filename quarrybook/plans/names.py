"""Names of an operator's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of an operator's own that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names
