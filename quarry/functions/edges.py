"""Column expressions over edges: metadata, mechanisms and labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import FILTER_TYPES, LABEL_OF, MECHANISM_OF


def _mapped(table: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.element_at(literal, key), key)


def mechanism(relationship: Column) -> Column:
    """The graph's mechanism of a relationship type; an unknown type is its own mechanism."""
    return _mapped(MECHANISM_OF, relationship)


def label(relationship: Column) -> Column:
    """The label that people read; an unknown type is its own label."""
    return _mapped(LABEL_OF, relationship)


def metadata_field(metadata: Column, name: str) -> Column:
    """A string of the metadata's JSON; null for bad JSON, absent keys and the empty string."""
    return F.nullif(F.get_json_object(metadata, f"$.{name}"), F.lit(""))


def described(relationship: Column, confidence: Column, event: Column | None = None, unresolved: Column | None = None) -> Column:
    """How a link is shown: the unresolved target first, then the event, then the confidence, then the bare label."""
    shown, text = F.when(F.lit(False), F.lit("")), label(relationship)
    if unresolved is not None:
        shown = shown.when(unresolved.isNotNull(), F.concat(text, F.lit(" -> [unresolved: "), unresolved, F.lit("]")))
    if event is not None:
        shown = shown.when(event.isNotNull(), F.concat(F.lit("event ("), event, F.lit(")")))
    return shown.when(confidence.isNotNull(), F.concat(text, F.lit(" ["), confidence, F.lit("]"))).otherwise(text)


def admitted(mechanism_filter: str | None, category: tuple[str, ...]) -> list[str]:
    """The relationship types of a category that a mechanism filter admits; an unknown filter admits none."""
    if not mechanism_filter:
        return list(category)
    return [t for t in category if t in FILTER_TYPES.get(mechanism_filter, ())]
