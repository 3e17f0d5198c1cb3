"""Import resolution: one lookup join of targets with the paths that files stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.paths import dirname, is_external, resolve
from graphloom.schema import AnalyzerOptions


def alias_target(source: Column, options: AnalyzerOptions, root: str) -> Column:
    """The path that the first fitting alias gives, by its first replacement; null if none fits."""
    base = options.base_url or root
    found = F.lit(None).cast("string")
    for pattern, replacements in reversed(list(options.path_aliases.items())):
        if not replacements:
            continue
        first = replacements[0]
        if pattern.endswith("/*"):
            prefix = pattern[:-1]
            to = first[:-2] if first.endswith("/*") else first
            rest = F.substring(source, len(prefix) + 1, 1 << 20)
            found = F.when(source.startswith(prefix), resolve(resolve(F.lit(base), F.lit(to)), rest)).otherwise(found)
        else:
            rest = F.substring(source, len(pattern) + 1, 1 << 20)
            found = F.when(source == pattern, resolve(F.lit(base), F.lit(first))).when(source.startswith(pattern + "/"), resolve(F.lit(base), F.concat(F.lit(first), rest))).otherwise(found)
    return found


def targets(path: Column, source: Column, root: str, options: AnalyzerOptions) -> Column:
    """The paths to try in order: an alias, then either the relative path alone or those under baseUrl and root."""
    alias = alias_target(source, options, root) if options.path_aliases else F.lit(None).cast("string")
    relative = resolve(dirname(path), source)
    rest = [resolve(F.lit(options.base_url), source)] if options.base_url else []
    rest.append(resolve(F.lit(root), source))
    return F.filter(F.when(source.startswith("."), F.array(alias, relative)).otherwise(F.array(alias, *rest)), lambda x: x.isNotNull())


def candidates(target: Column, extensions: list[str]) -> Column:
    """The files that stand for a path, best first: itself, with an extension, an index file, TypeScript for ``.js``."""
    tried = [target, *(F.concat(target, F.lit(x)) for x in extensions), *(F.concat(target, F.lit("/index" + x)) for x in extensions)]
    bare = F.regexp_replace(target, r"\.js$", "")
    swapped = F.when(target.endswith(".js"), F.array(F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(*tried), swapped)


def lookup(files: DataFrame, extensions: list[str]) -> DataFrame:
    """(target, resolved): the best of ``files`` (path) for each path that any stands for.

    Suffixes tell what a file stands for, two or three paths for a source file;
    ``pos`` is its place among the path's ``candidates``.
    """
    suffixes = ["", *extensions, *("/index" + x for x in extensions)]
    ways = [(suffix, "", pos) for pos, suffix in enumerate(suffixes)]
    ways += [(".ts", ".js", len(suffixes)), (".tsx", ".js", len(suffixes) + 1)]
    # of suffixes that none of the others ends with, one fits at most: a row for each such group is enough
    groups: list[list[tuple[str, str, int]]] = []
    for way in ways:
        fitting = (g for g in groups if not any(way[0].endswith(x) or x.endswith(way[0]) for x, _, _ in g))
        group = next(fitting, None)
        if group is None:
            groups.append(group := [])
        group.append(way)
    chosen = lambda g: reduce(lambda c, w: c.when(F.col("path").endswith(w[0]), F.struct(F.lit(w[0]).alias("suffix"), F.lit(w[1]).alias("to"), F.lit(w[2]).alias("pos"))), g, F)
    tried = files.select("path", F.inline(F.array(*map(chosen, groups)))).filter("pos IS NOT NULL")
    target = F.concat(F.left("path", F.length("path") - F.length("suffix")), "to")
    # an index file at the top stands for the top
    stood = tried.select(F.when(target == "", "/").otherwise(target).alias("target"), "path", "pos")
    return stood.groupBy("target").agg(F.min_by("path", "pos").alias("resolved"))


def resolve_imports(imports: DataFrame, files: DataFrame, root: str, options: AnalyzerOptions = AnalyzerOptions()) -> DataFrame:
    """``imports`` (path, idx, source, ...) that resolve to a row of ``files`` (path), with ``resolved``.

    External imports are dropped before anything else. Each target is one key of
    one join with ``lookup``, which Spark broadcasts if it is small; without
    aliases and base URL an import has one target, and nothing else is shuffled.
    """
    outside = is_external(F.col("source"))
    if options.strict_aliases and options.path_aliases:
        outside &= alias_target(F.col("source"), options, root).isNull()
    inner = imports.filter(~outside)
    index = lookup(files, options.extensions).withColumnRenamed("target", "_target")
    if not options.path_aliases and not options.base_url:
        target = resolve(F.when(F.col("source").startswith("."), dirname(F.col("path"))).otherwise(root), F.col("source"))
        return inner.withColumn("_target", target).join(index, "_target").drop("_target")
    tried = targets(F.col("path"), F.col("source"), root, options)
    aimed = inner.select("path", "idx", F.posexplode(tried).alias("_nth", "_target"))
    best = aimed.join(index, "_target").groupBy("path", "idx").agg(F.min_by("resolved", "_nth").alias("resolved"))
    return inner.join(best, ["path", "idx"])
