"""Results as JSON of bounded size, shaped on the driver: lists are short by then."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

LIMIT, ITEMS, MARGIN = 4000, 10, 50


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def envelope(summary: str, data: list, total: int, truncated: bool) -> dict:
    return {"summary": summary, "data": data, "total": total, "truncated": truncated}


def _clipped(value: Any, width: int) -> Any:
    """Strings longer than ``width`` cut, in nested objects too; lists stay as they are."""
    if isinstance(value, str) and len(value) > width:
        return value[:width] + "..."
    return {k: _clipped(v, width) for k, v in value.items()} if isinstance(value, dict) else value


def list_response(items: list, summary: Callable[[list], str], most: int = ITEMS, total: int | None = None) -> str:
    """A list's envelope within the limit: fewer items, halved until they fit; of a single one the strings are cut.

    ``total`` counts all items where ``items`` are only the first of them.
    """
    total = len(items) if total is None else total
    n = max(1, min(most, len(items)))
    while True:
        shown = items[:n]
        text = compact(envelope(summary(shown), shown, total, total > len(shown)))
        if len(text) <= LIMIT or n == 1:
            break
        n = max(1, n // 2)
    if len(text) <= LIMIT:
        return text
    full = json.loads(text)
    width = LIMIT - len(compact(full | {"data": [{}]})) - MARGIN
    if width <= 0:
        return compact(full | {"data": [], "truncated": True})
    for w in (width, width // 2):
        text = compact(full | {"data": [_clipped(i, w) for i in full["data"]]})
        if len(text) <= LIMIT:
            return text
    return text[:LIMIT]


def single_response(item: Any, summary: str) -> str:
    return compact(envelope(summary, [item], 1, False))


def impact_response(summary: str, stats: dict, entries: list[tuple[str, str, list[str]]]) -> dict:
    """Tiers as name-to-mechanisms objects; transitive ones fill what the limit leaves, and the rest is counted."""
    tier = lambda t: {name: mech for kind, name, mech in entries if kind == t}
    out = {"summary": summary, "stats": stats, "direct": tier("direct"), "indirect": tier("indirect"), "transitive": {}}
    far = [(name, mech) for kind, name, mech in entries if kind == "transitive"]
    room = LIMIT - len(compact(out)) - len(compact({"transitive_truncated": f"...and {len(far)} more"}))
    shown = 0
    for name, mech in far:
        room -= len(compact({name: mech}))
        if room < 0:
            break
        out["transitive"][name] = mech
        shown += 1
    return out | ({"transitive_truncated": f"...and {len(far) - shown} more"} if shown < len(far) else {})


def field_impact_response(field: str, summary: str, origins: list[dict], boundaries: list[dict], consumers: list[dict]) -> dict:
    """Consumers give way first, then origins, from the end, until the limit holds."""
    out = {"summary": summary, "field": field, "origins": list(origins), "boundaries": boundaries, "consumers": list(consumers)}
    for part in ("consumers", "origins"):
        while out[part] and len(compact(out)) > LIMIT:
            out[part].pop()
    return out
