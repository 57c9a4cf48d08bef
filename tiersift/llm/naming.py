"""Names for working columns beside a user's own."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, each with so many underscores in front that no column of any case has it."""
    held = {t.lower() for t in taken}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in held:
            pass
        out.append(name)
    return tuple(out)
