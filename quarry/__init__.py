"""quarry: a PySpark-native code-intelligence engine.

Source repositories are scanned into a relational model of modules, fields,
events, services and edges; ranked text search, entity cards, dependency,
impact, trace, field-impact and overview queries run over it as DataFrames.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

#: What the package offers by name, and where it is.
_OFFERED = {
    "quarry.session": ("local_session",),
    "quarry.schema": ("Model", "SCHEMA_VERSION", "TABLES"),
    "quarry.functions.text": ("tokenized",),
    "quarry.plans.store": ("Store", "facts_listed"),
    "quarry.plans.text_index": ("TextIndex",),
    "quarry.plans.stored_graph": ("GraphStore",),
    "quarry.plans.indexing": ("extracted", "index_all", "tables_of"),
    "quarry.api": ("Knowledge", "ToolError"),
    "quarry.server": ("serve",),
    "quarry.sources.repositories": ("discover", "metadata", "working_tree"),
    "quarry.sources.repository_source": ("RepositorySource",),
    "quarry.sources.git": ("current_commit", "reachable"),
    "quarry.operators.extract": ("elixir_modules", "event_relationships", "proto_messages", "proto_services", "graphql_types"),
    "quarry.operators.search": ("fts_docs", "postings", "phrase", "ranked", "search_text"),
    "quarry.operators.entities": ("find_entities",),
    "quarry.operators.dependencies": ("dependencies",),
    "quarry.operators.graph": ("graph_edges", "downstream", "upstream", "shortest_paths", "two_ended_paths"),
    "quarry.operators.impact": ("impact_entries", "impact_stats"),
    "quarry.operators.trace": ("trace_hops", "trace_summaries"),
    "quarry.streaming.ingest": ("file_stream", "merge_batch", "repository_stream", "start"),
    "quarry.streaming.sync": ("changed_files", "snapshot_stream"),
}
_PLACE = {name: module for module, names in _OFFERED.items() for name in names}
__all__ = ["__version__", *sorted(_PLACE)]


def __getattr__(name: str):
    """Loads what is asked for when it is asked for."""
    if name not in _PLACE:
        raise AttributeError(f"module 'quarry' has no attribute {name!r}")
    return getattr(import_module(_PLACE[name]), name)
