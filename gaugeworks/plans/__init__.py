"""Named queries. Importing a module of this package registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("coverage_queries", "issue_queries", "path_queries", "linter_queries", "format_queries", "tree_queries", "metric_queries", "sink_queries", "change_queries", "fix_queries", "workspace_queries")


def registry():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from ..catalog import REGISTRY

    return REGISTRY
