"""Names of inner columns that never meet a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def inner(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes that no column has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
