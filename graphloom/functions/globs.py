"""Path globs: ``**`` for any directories, ``*`` and ``?`` within a segment."""

from __future__ import annotations

import re

_WILD = {"*": "[^/]*", "?": "[^/]"}


def _segment(text: str) -> str:
    return "".join(_WILD.get(c) or re.escape(c) for c in text)


def glob_regex(pattern: str) -> str:
    """A regular expression for what the glob matches, and for all that is below that."""
    *above, last = pattern.rstrip("/").split("/")
    begin = "".join("(?:[^/]+/)*" if x == "**" else _segment(x) + "/" for x in above)
    if last == "**":
        return "^" + (begin[:-1] + "(?:/|$)" if begin.endswith("/") else begin)
    return "^" + begin + _segment(last) + "(?:/|$)"
