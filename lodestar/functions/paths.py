"""Path strings."""

from __future__ import annotations

import re


def clean_path(path: str) -> str:
    """No doubled slashes and none at the end; a scheme keeps its own."""
    scheme, mark, rest = path.rpartition("://")
    rest = re.sub("/+", "/", rest)
    return scheme + mark + (rest.rstrip("/") or "/")
