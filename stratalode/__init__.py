"""Source-corpus and training-data analytics as DataFrame operators on Spark.

The names below are loaded when they are first used: executors import parts of the
package and should not pay for all of it.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_PLACES = {
    "scan_repo": ("sources.files", "from_directory"),
    "files_of": ("sources.files", "from_table"),
    "parse_repo_arg": ("operators.scan", "parse_repo_arg"),
    "detect_primary_language": ("operators.scan", "primary_language"),
    "check_scope": ("operators.scan", "scope_check"),
    "detect_candidates": ("operators.candidates", "detect"),
    "examine_files": ("operators.candidates", "examine"),
    "score_candidates": ("operators.scoring", "score"),
    "build_search_query": ("operators.naming", "search_query"),
    "parse_search_response": ("operators.search", "parse_response"),
    "similar_projects": ("operators.search", "similar_projects"),
    "compute_differentiators": ("operators.search", "differentiators"),
    "choose_candidates": ("operators.extract", "chosen"),
    "extract_candidates": ("operators.extract", "package_files"),
    "write_packages": ("operators.extract", "write_packages"),
    "generate_report": ("operators.report", "render"),
    "analyze_repo": ("analysis", "analyze_repo"),
    "FILE_SCHEMA": ("sources.files", "FILE_SCHEMA"),
    "PROJECT_SCHEMA": ("operators.search", "PROJECT"),
}
__all__ = ["__version__", *_PLACES]


def __getattr__(name: str) -> object:
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, attribute = _PLACES[name]
    return getattr(importlib.import_module(f"{__name__}.{module}"), attribute)
