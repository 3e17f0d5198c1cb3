"""graphloom: dependency-graph analytics on Spark DataFrames.

The public names are loaded when they are first used, so that Python workers
import only the modules that their functions need:

    from graphloom import analyze_directory, AnalyzerOptions, Graph, find_cycles
"""

from importlib import import_module

_HOME = {
    "functions.parse": ["init_parser", "parse_file", "parse_source", "with_imports"],
    "functions.paths": ["is_supported", "language_of", "language_of_name"],
    "operators.cycles": ["find_all_simple_cycles", "find_cycles", "find_cycles_involving_file", "find_longest_cycle", "find_strong_components", "has_cycles", "strong_component_labels"],
    "operators.fixpoint": ["closure", "reachable", "weak_components"],
    "operators.graph": ["Graph"],
    "operators.viewer": ["dim_elements", "filter_elements", "highlight_elements", "selected_node", "view_edges", "view_nodes", "view_stats"],
    "plans.analyze": ["AnalysisResult", "analyze_directory", "analyze_file", "has_circular_dependencies"],
    "schema": ["DEFAULT_EXTENSIONS", "DEFAULT_IGNORE_DIRS", "EXTENSION_TO_LANGUAGE", "AnalyzerOptions"],
}
_MODULE = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_MODULE[name]}"), name)
