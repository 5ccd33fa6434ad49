"""Names of tables and columns."""

from __future__ import annotations

import re
from pathlib import PurePosixPath


def table_name(path: str) -> str:
    """Letters of any script, digits and underscores, at most 63 characters; no digit first."""
    name = re.sub(r"\W+", "_", PurePosixPath(path).name.rsplit(".", 1)[0]).strip("_") or "table"
    return (f"t_{name}" if name[0].isdigit() else name)[:63]


def distinct(names: list[str]) -> list[str]:
    """Repeats become _2, _3 and so on."""
    seen: set[str] = set()
    out = []
    for n in names:
        k, name = 1, n
        while name in seen:
            k += 1
            name = f"{n}_{k}"
        seen.add(name)
        out.append(name)
    return out


def column_names(header: list[str]) -> list[str]:
    return distinct([h.strip() or f"column_{i}" for i, h in enumerate(header, 1)])
