"""Reading JSON payloads that exporters wrote unevenly."""

from __future__ import annotations

import json
from typing import Any

BOM = "﻿"
#: JSON text inside a JSON string is unwrapped so often at most.
WRAPS = 8


def whole_json(text: str | None) -> Any:
    """The value of a payload, or None if it is not whole JSON.

    A byte-order mark before it is ignored; a JSON string that holds JSON text is unwrapped.
    """
    value: Any = text
    for _ in range(WRAPS):
        if not isinstance(value, str):
            return value
        try:
            value = json.loads(value.strip().lstrip(BOM).strip())
        except (ValueError, RecursionError):
            return None
    return None


def listed(value: Any) -> list:
    """A list as it is, nothing as an empty list, anything else as a list of one."""
    return value if isinstance(value, list) else [] if value is None else [value]


def cases_of(document: Any) -> list:
    """The cases of a chunk: in ``value``, or in ``Cases`` if there is no ``value``."""
    if not isinstance(document, dict):
        return []
    value = document.get("value")
    return listed(document.get("Cases") if value is None else value)
