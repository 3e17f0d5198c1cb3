"""Path algebra and predicates on paths, as Column functions."""

from __future__ import annotations

import posixpath
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from graphloom.schema import EXTENSION_TO_LANGUAGE


def basename(path: Column) -> Column:
    """The last segment; the path itself if that is empty."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last == "", path).otherwise(last)


def dirname(path: Column) -> Column:
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when((cut == "") & path.startswith("/"), "/").otherwise(cut)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for names that only start with a dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """The language by extension; null if it is not supported."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSION_TO_LANGUAGE.items() for x in kv])
    return known[extension(path)]


def language_of_name(path: str) -> str | None:
    return EXTENSION_TO_LANGUAGE.get(posixpath.splitext(posixpath.basename(path))[1].lower())


def is_supported(path: Column) -> Column:
    return language_of(path).isNotNull()


def normalise(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments; one that is such already is not taken apart."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(path.rlike(r"\A(?:/(?!\.{0,2}(?:/|\z))[^/]++)++\z"), path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolve(base: Column, path: Column) -> Column:
    """``path`` seen from the directory ``base``, normalised."""
    below = F.when(path.startswith("./"), F.substring(path, 3, 1 << 20)).otherwise(path)
    return normalise(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), below)))


def relative(path: Column, base: str) -> Column:
    """``path`` relative to the directory ``base``; exact for paths under it, with ``../`` for others."""
    root = posixpath.normpath(base)
    prefix = root.rstrip("/") + "/"
    segments = [x for x in root.split("/") if x]
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    own = F.array(*map(F.lit, segments)) if segments else F.array().cast("array<string>")
    # how many leading segments agree
    same = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(segments)))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(parts, i - 1) == F.get(own, i - 1)), i).otherwise(n))
    up = F.concat(F.repeat(F.lit("../"), F.lit(len(segments)) - same), F.array_join(F.slice(parts, same + 1, F.greatest(F.size(parts) - same, F.lit(0))), "/"))
    return F.when(path == root, "").when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(up)


def is_external(source: Column) -> Column:
    """Whether an import names a package: all but ``.``-led and absolute paths, and ``@name`` without a slash."""
    return F.when(source.startswith(".") | source.startswith("/"), False).when(source.startswith("@"), source.contains("/")).otherwise(True)


def _ignoring(pattern: str) -> str:
    """One regular expression to search a path for: the pattern's text, or with ``*`` all of the path or of its last segment."""
    if "*" not in pattern:
        return re.escape(pattern)
    return r"^(?:(?s:.*)/(?=[^/]*$))?" + pattern.replace("*", ".*").replace("?", ".") + "$"


def should_ignore(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits; with ``*``, ``?`` stands for one character and others are as in a regular expression."""
    return reduce(or_, (path.rlike(_ignoring(p)) for p in patterns), F.lit(False))


def ignores(path: str, patterns: list[str]) -> bool:
    """``should_ignore`` for one path."""
    return any(re.search(_ignoring(p), path) for p in patterns)


def matches_view_pattern(path: Column, pattern: str) -> Column:
    """Case-insensitive match anywhere; only ``*`` and ``?`` are special; an empty pattern matches all."""
    if not pattern:
        return F.lit(True)
    wild = {"*": ".*", "?": "."}
    return path.rlike("(?i)" + "".join(wild.get(c) or re.escape(c) for c in pattern))
