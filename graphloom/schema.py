"""Schemas, constants and options of the dependency-graph engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# File extensions by language, in order of resolution priority, and ignored directories.
EXTENSION_TO_LANGUAGE = {
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "jsx",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".mts": "typescript",
    ".cts": "typescript",
}
DEFAULT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
DEFAULT_IGNORE_DIRS = ["node_modules", "dist", "build", ".git", "coverage", ".next", ".nuxt"]

IMPORT = "struct<source:string,specifiers:array<string>,type:string,line:int>"
IMPORTS = f"array<{IMPORT}>"
NODES_SCHEMA = "file_path string, ord long"
EDGES_SCHEMA = "src string, dst string, src_ord long, pos long"
#: rank: what the cycles are ordered by
CYCLES_SCHEMA = "chain array<string>, length int, rank array<long>"
ERRORS_SCHEMA = "file string, error string"
VIEWER_SCHEMA = (
    "nodes map<string,struct<filePath:string,dependencies:array<string>,dependents:array<string>>>, "
    "cycles array<struct<chain:array<string>,length:int>>, rootDir string, "
    "stats struct<totalFiles:long,totalDependencies:long,circularDependencies:long>"
)


@dataclass(frozen=True)
class AnalyzerOptions:
    """What an analysis reads and how it resolves; ``follow_symlinks`` is accepted and has no effect."""

    extensions: list[str] = field(default_factory=lambda: list(DEFAULT_EXTENSIONS))
    ignore_dirs: list[str] = field(default_factory=lambda: list(DEFAULT_IGNORE_DIRS))
    ignore_patterns: list[str] = field(default_factory=list)
    follow_symlinks: bool = False
    base_url: str | None = None
    path_aliases: dict[str, list[str]] = field(default_factory=dict)
    #: an extension: try aliases before a specifier counts as external
    strict_aliases: bool = False
