"""Entities of all kinds in one shape, their relationships, and lookups by name."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schema import COARSE_TYPES, MODULE_SUB_TYPES, SEARCHED_TYPES, SERVICE_SUB_TYPES, Model

if TYPE_CHECKING:
    from quarry.operators.search import Index

CARD = ("entity_type", "sub_type", "entity_id", "name", "repo", "file_path", "description")
FACT_CHARS, FACT_REPO = 100, "user-knowledge"


def _card(df: DataFrame, kind: str, sub_type: Column | None = None, **columns: Column | str) -> DataFrame:
    given = {"entity_type": F.lit(kind), "sub_type": F.coalesce(sub_type, F.lit(kind)) if sub_type is not None else F.lit(kind), "file_path": F.lit(None).cast("string")} | columns
    return df.select(*[(F.col(given[c]) if isinstance(given[c], str) else given[c]).alias(c) for c in CARD])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with_repo(df: DataFrame, model: Model) -> DataFrame:
    return df.join(model.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id")


def _required() -> Column:
    return F.when(F.col("nullable"), "nullable").otherwise("required")


def _shared_cards(model: Model) -> list[DataFrame]:
    files = model.files.select(F.col("id").alias("file_id"), F.col("path").alias("own_path"))
    modules = _with_repo(model.modules, model).join(files, "file_id", "left")
    return [
        _card(model.repos, "repo", entity_id="id", name="name", repo="name", description="description"),
        _card(modules, "module", F.col("type"), entity_id="id", name="name", repo="repo", file_path="own_path", description="summary"),
        _card(_with_repo(model.events, model), "event", entity_id="id", name="name", repo="repo", file_path="source_file", description="schema_definition"),
        _card(_with_repo(model.services, model), "service", F.col("service_type"), entity_id="id", name="name", repo="repo", description="description"),
    ]


def entity_cards(model: Model) -> DataFrame:
    """Every entity that a search hit can name, as it is shown there."""
    fields = _with_repo(model.fields, model)
    text = F.concat_ws(" ", "parent_type", "field_type", _required())
    facts = model.learned_facts
    short = F.when(F.length("content") > FACT_CHARS, F.concat(F.substring("content", 1, FACT_CHARS), F.lit("..."))).otherwise(F.col("content"))
    return _union(
        [
            *_shared_cards(model),
            _card(fields, "field", F.col("parent_type"), entity_id="id", name="field_name", repo="repo", file_path="source_file", description=text),
            _card(facts, "learned_fact", entity_id="id", name=short, repo=F.coalesce("repo", F.lit(FACT_REPO)), description="content"),
        ]
    )


def exact_cards(model: Model) -> DataFrame:
    """Entities as a lookup by exact name shows them: fields say where they belong and are typed."""
    fields = _with_repo(model.fields, model)
    text = F.concat("parent_type", F.lit(" "), "parent_name", F.lit("."), "field_name", F.lit(": "), "field_type", F.lit(" ("), _required(), F.lit(")"))
    return _union([*_shared_cards(model), _card(fields, "field", F.col("parent_type"), entity_id="id", name="field_name", repo="repo", file_path="source_file", description=text)])


def name_cards(model: Model) -> DataFrame:
    """(entity_type, entity_id, name): what an edge's end is called; a file by its path."""
    tables = {"repo": (model.repos, "name"), "module": (model.modules, "name"), "event": (model.events, "name"), "service": (model.services, "name"), "file": (model.files, "path"), "field": (model.fields, "field_name")}
    return _union([df.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.col(name).alias("name")) for kind, (df, name) in tables.items()])


def relationships(model: Model) -> DataFrame:
    """(entity_type, entity_id, direction, type, other_type, other_name, edge_id): both ends of every edge; unknown others are left out."""
    names = name_cards(model).select(F.col("entity_type").alias("other_type"), F.col("entity_id").alias("other_id"), F.col("name").alias("other_name"))
    side = lambda mine, other, way: model.edges.select(
        F.col(f"{mine}_type").alias("entity_type"), F.col(f"{mine}_id").alias("entity_id"), F.lit(way).alias("direction"), F.col("relationship_type").alias("type"),
        F.col(f"{other}_type").alias("other_type"), F.col(f"{other}_id").alias("other_id"), F.col("id").alias("edge_id"),
    )
    return side("source", "target", "outgoing").unionByName(side("target", "source", "incoming")).join(names, ["other_type", "other_id"]).select("entity_type", "entity_id", "direction", "type", "other_type", "other_name", "edge_id")


def type_predicate(wanted: str | None) -> Column:
    """Which cards a type filter of an exact lookup admits.

    A coarse type is a kind of entity; a known sub-type is a kind with that sub-type; anything
    else admits every searched kind.
    """
    kind = F.col("entity_type")
    if wanted in COARSE_TYPES:
        return kind == wanted
    if wanted in MODULE_SUB_TYPES or wanted in SERVICE_SUB_TYPES:
        return (kind == ("module" if wanted in MODULE_SUB_TYPES else "service")) & (F.col("sub_type") == wanted)
    return kind.isin(*SEARCHED_TYPES)


def exact_entities(model: Model, names: DataFrame, wanted: str | None = None, repo: str | None = None) -> DataFrame:
    """Cards whose name is exactly one of ``names`` (query).

    Where a name's field cards span two repositories or more, each says so.
    """
    rows = exact_cards(model).join(names.select(F.col("query").alias("name")).distinct(), "name").filter(type_predicate(wanted))
    if repo is not None:
        rows = rows.filter(F.col("repo") == repo)
    spread = rows.filter("entity_type = 'field'").groupBy("name").agg(F.count_distinct("repo").alias("repos")).filter("repos >= 2")
    rows = rows.join(spread, "name", "left")
    shared = (F.col("entity_type") == "field") & F.col("repos").isNotNull()
    text = F.when(shared, F.concat(F.lit("[shared across "), F.col("repos"), F.lit(" repos] "), F.col("description"))).otherwise(F.col("description"))
    return rows.withColumn("description", text).select(F.col("name").alias("query"), *CARD)


def with_relationships(model: Model, cards: DataFrame, only: str | None = None) -> DataFrame:
    """Cards with their relationships as an array, outgoing first; ``only`` keeps cards that have one of that type."""
    rel = relationships(model)
    entry = F.struct(F.when(F.col("direction") == "outgoing", 0).otherwise(1).alias("side"), "edge_id", "direction", "type", "other_type", "other_name")
    listed = rel.groupBy("entity_type", "entity_id").agg(F.array_sort(F.collect_list(entry)).alias("relationships"))
    if only is not None:
        cards = cards.join(rel.filter(F.col("type") == only).select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_semi")
    rows = cards.join(listed, ["entity_type", "entity_id"], "left")
    return rows.withColumn("relationships", F.coalesce(F.transform("relationships", lambda r: r.dropFields("side", "edge_id")), F.array()))


def in_reading_order(cards: DataFrame) -> DataFrame:
    """Sorted by repository and name as people sort them."""
    return cards.orderBy(F.collate("repo", "UNICODE"), F.collate("name", "UNICODE"), "entity_type", "entity_id")


def find_entities(model: Model, docs: DataFrame, name: str, wanted: str | None = None, relationship: str | None = None, repo: str | None = None, index: Index | None = None) -> DataFrame:
    """Cards of a name: exact ones, or if there are none, those of a ranked search; sorted for reading."""
    from quarry.operators.search import fallback_cards

    if not name or not name.strip():
        cards = exact_cards(model).limit(0)
    else:
        cards = exact_entities(model, model.spark.createDataFrame([(name,)], "query string"), wanted, repo).drop("query")
        if cards.isEmpty():
            cards = fallback_cards(model, docs, name, wanted, repo, index)
    return in_reading_order(with_relationships(model, cards, relationship))
