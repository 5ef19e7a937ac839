"""What several test modules share."""
from __future__ import annotations


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
