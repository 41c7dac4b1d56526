"""Compact text of a small result, for people and models: on the driver, over rows that are collected anyway."""

from __future__ import annotations

import json

#: Bytes of an array of scalars that stays on one line.
INLINE = 120


def compact(value, indent: int = 0) -> str:
    """A tree as indented text: empty parts left out, two or more flat objects as one table, short arrays in line."""
    pad = "  " * indent
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            if v is None or v in ("", [], {}):
                continue
            text = compact(v, indent + 1)
            out.append(f"{pad}{k}:\n{text}" if "\n" in text or isinstance(v, dict) or text.startswith("  ") else f"{pad}{k}: {text}")
        return "\n".join(out)
    if isinstance(value, list):
        if len(value) > 1 and all(isinstance(v, dict) and all(not isinstance(x, (dict, list)) for x in v.values()) for v in value):
            names = list(dict.fromkeys(k for v in value for k in v))
            rows = [" | ".join("" if v.get(n) is None else scalar(v[n]) for n in names) for v in value]
            return "\n".join(pad + r for r in [" | ".join(names), *rows])
        if all(not isinstance(v, (dict, list)) for v in value):
            line = ", ".join(map(scalar, value))
            return line if len(line.encode()) <= INLINE else "\n".join(f"{pad}- {scalar(v)}" for v in value)
        return "\n".join(f"{pad}-\n{compact(v, indent + 1)}" for v in value)
    return scalar(value)


def scalar(x) -> str:
    return x.replace("\n", "\\n") if isinstance(x, str) else json.dumps(x, default=str)


def frame(df, limit: int = 100) -> str:
    """The first rows of a result as a table."""
    return compact([r.asDict(recursive=True) for r in df.limit(limit).collect()])
