"""Names for helper columns."""

from __future__ import annotations


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as tell it from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out
