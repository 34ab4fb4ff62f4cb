"""Text search and entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import tokenized
from quarry.operators import entities, search
from quarry.plans.derived import derived
from quarry.plans.model_map import STAR_SQL, document_texts, star_model
from quarry.plans.registry import query
from quarry.plans.text_index import built

_TOK = "trim(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')))".format
_LIST = "list_filter(string_split(" + _TOK("coalesce({0}, '')").replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + ", ' '), lambda w: w <> '')"
_KEY = "entity_type, sub_type, entity_id"

#: The texts of the model's entities and of the documents, and the index over them.
INDEX_SQL = f"""{STAR_SQL},
texts AS (
  SELECT 'repo' AS entity_type, 'repo' AS sub_type, id AS entity_id, name, description FROM repos
  UNION ALL SELECT 'module', m.type, m.id, m.name, concat_ws(' ', r.name, summary, 'table:' || table_name) FROM modules m JOIN repos r ON r.id = m.repo_id
  UNION ALL SELECT 'event', 'event', e.id, e.name, concat_ws(' ', r.name, schema_definition) FROM model_events e JOIN repos r ON r.id = e.repo_id
  UNION ALL SELECT 'service', service_type, s.id, s.name, concat_ws(' ', r.name, s.description) FROM services s JOIN repos r ON r.id = s.repo_id
  UNION ALL SELECT 'field', parent_type, f.id, field_name, concat_ws(' ', r.name, parent_name, field_type, CASE WHEN parent_type = 'proto_message' THEN 'event:' || parent_name END) FROM fields f JOIN repos r ON r.id = f.repo_id
  UNION ALL SELECT 'learned_fact', 'learned_fact', id, content, repo FROM facts),
all_texts AS (SELECT * FROM texts UNION ALL SELECT 'file', lang, doc_id, source, text FROM documents),
docs AS MATERIALIZED (SELECT {_KEY}, {_LIST.format('name')} AS name_tokens, {_LIST.format('description')} AS desc_tokens FROM all_texts),
sized AS MATERIALIZED (SELECT *, (len(name_tokens) + len(desc_tokens))::INT AS dl FROM docs),
postings AS MATERIALIZED (SELECT term, {_KEY}, dl, count(*)::BIGINT AS tf FROM (SELECT {_KEY}, dl, unnest(list_concat(name_tokens, desc_tokens)) AS term FROM sized) GROUP BY ALL),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(dl)::BIGINT AS total_len FROM sized)"""


def _hits_sql(name: str, groups: list[list[str]], every: bool, prefix: bool = False) -> str:
    """Scored hits of a query of groups of terms, as common table expressions that end in ``name``."""
    terms = ", ".join(f"({g}, {k}, '{t}', {str(prefix and k == len(ts) - 1).lower()})" for g, ts in enumerate(groups) for k, t in enumerate(ts))
    sizes = ", ".join(f"({g}, {len(ts)})" for g, ts in enumerate(groups))
    need = len(groups) if every else 1
    return f"""
{name}_t(g, k, q, open) AS (VALUES {terms}),
{name}_s(g, size) AS (VALUES {sizes}),
{name}_h AS (SELECT g, k, {_KEY}, dl, sum(tf)::BIGINT AS tf FROM postings JOIN {name}_t ON term = q OR (open AND starts_with(term, q)) GROUP BY ALL),
{name}_n AS (SELECT g, k, count(*) AS n FROM {name}_h GROUP BY ALL),
{name}_w AS (SELECT h.*, CASE WHEN ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl * n_docs / total_len))) AS s FROM {name}_h h JOIN {name}_n USING (g, k), stats),
{name}_g AS (SELECT g, {_KEY}, count(*) AS have, sum(s) AS s FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {_KEY}, round(-sum(s), 6) AS score FROM {name}_g JOIN {name}_s USING (g) GROUP BY ALL HAVING count(*) FILTER (have = size) >= {need})"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([INDEX_SQL, *ctes]) + "\n" + body


_TOP = f"ORDER BY score, entity_type, entity_id LIMIT "
_OUT = f"SELECT {_KEY}, score FROM "


def _texts(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return model, search.index_texts(model).unionByName(document_texts(spark, sf_dir), allowMissingColumns=True)


def _docs(spark, sf_dir):
    model, texts = _texts(spark, sf_dir)
    return model, search.fts_docs(texts)


def _index(spark, sf_dir):
    """(model, documents, index): as stored, so a question reads the postings of its terms and no text."""
    index = derived(spark, sf_dir, "fts", lambda path: built(spark, path, _texts(spark, sf_dir)[1]))
    return star_model(spark, sf_dir), index.docs(), index.searchable()


@query(f"WITH {STAR_SQL}\nSELECT id, {_TOK('name')} AS tokens FROM modules")
def tokenize_names(spark, sf_dir):
    return star_model(spark, sf_dir).modules.select("id", tokenized(F.col("name")).alias("tokens"))


@query(f"SELECT doc_id, {_TOK('text')} AS tokens FROM documents")
def tokenize_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokenized(F.col("text")).alias("tokens"))


@query(_with(f"SELECT {_KEY}, array_to_string(name_tokens, ' ') AS name, array_to_string(desc_tokens, ' ') AS description, dl FROM sized"))
def fts_docs_union(spark, sf_dir):
    return _docs(spark, sf_dir)[1].select("entity_type", "sub_type", "entity_id", F.array_join("name_tokens", " ").alias("name"), F.array_join("desc_tokens", " ").alias("description"), "dl")


@query(_with(f"SELECT term, {_KEY}, dl, tf, substr(term, 1, 2) AS p2, substr(term, 1, 3) AS p3 FROM postings"))
def fts_postings(spark, sf_dir):
    return search.postings(_docs(spark, sf_dir)[1])


@query(_with("SELECT n_docs, total_len FROM stats"))
def fts_stats(spark, sf_dir):
    return search.index_stats(_docs(spark, sf_dir)[1])


@query(_with(_OUT + "h", _hits_sql("h", [["nation"]], True)))
def fts_single(spark, sf_dir):
    _, docs, index = _index(spark, sf_dir)
    return search.scored(index.postings, index.stats, search.Query((("nation",),), True))


@query(_with(_OUT + "h", _hits_sql("h", [["small"], ["ring"]], True)))
def fts_and(spark, sf_dir):
    _, docs, index = _index(spark, sf_dir)
    return search.scored(index.postings, index.stats, search.Query(search.words_of("small ring"), True))


@query(_with(_OUT + "h", _hits_sql("h", [["small", "ring"], ["widget"]], False)))
def fts_or(spark, sf_dir):
    """``SmallRing widget``: the tokens of one word belong together."""
    _, docs, index = _index(spark, sf_dir)
    return search.scored(index.postings, index.stats, search.Query(search.words_of("SmallRing widget"), False))


@query(_with(_OUT + "h", _hits_sql("h", [["brand", "1"], ["eve"]], False, True)))
def fts_prefix_or(spark, sf_dir):
    _, docs, index = _index(spark, sf_dir)
    return search.scored(index.postings, index.stats, search.Query(search.words_of("Brand#1 eve"), False, True))


@query(_with(f"SELECT {_KEY} FROM sized WHERE contains(' ' || array_to_string(name_tokens, ' ') || ' ', ' cold bolt ') OR contains(' ' || array_to_string(desc_tokens, ' ') || ' ', ' cold bolt ')"))
def fts_phrase(spark, sf_dir):
    return search.phrase(_index(spark, sf_dir)[2], "cold bolt")


@query(_with(_OUT + "h " + _TOP + "20", _hits_sql("h", [["hot"], ["gear"]], True)))
def fts_bm25_topk(spark, sf_dir):
    _, docs, index = _index(spark, sf_dir)
    return search.ranked(index, "hot gear")


@query(_with(f"""SELECT entity_type || ':' || sub_type AS entity_type, entity_id, array_to_string(name_tokens, ' ') AS name, array_to_string(desc_tokens, ' ') AS description, score
  FROM (SELECT * FROM h {_TOP}20) JOIN sized USING (entity_type, sub_type, entity_id)""", _hits_sql("h", [["hot"], ["gear"]], True)))
def fts_raw(spark, sf_dir):
    """The same hits with their tokens and composite type, as the index holds them."""
    _, docs, index = _index(spark, sf_dir)
    return search.raw_search(docs, "hot gear", index=index)


#: The texts after modules were renamed and fields removed.
_CHANGED_SQL = INDEX_SQL.replace("all_texts AS (SELECT * FROM texts UNION ALL", "all_texts AS (SELECT entity_type, sub_type, entity_id, CASE WHEN entity_type = 'module' THEN 'Renamed ' || name ELSE name END AS name, description FROM texts WHERE entity_type <> 'field' UNION ALL")


def _changed_index(spark, sf_dir):
    """The stored index after a change that is written as a segment of its own: every module renamed, every field removed."""
    model, texts = _texts(spark, sf_dir)
    index = derived(spark, sf_dir, "fts", lambda path: built(spark, path, texts))
    renamed = search.index_texts(model).filter("entity_type = 'module'").withColumn("name", F.concat(F.lit("Renamed "), "name"))
    return index.changed(renamed, model.fields.select(F.lit("field").alias("entity_type"), F.col("id").alias("entity_id")))


@query("WITH " + _CHANGED_SQL + f",{_hits_sql('h', [['renamed'], ['gear']], True)}\n" + _OUT + "h " + _TOP + "20")
def fts_after_change(spark, sf_dir):
    """Ranked over the changed index: replaced documents by their new texts, statistics as carried on."""
    return search.ranked(_changed_index(spark, sf_dir).searchable(), "renamed gear")


@query("WITH " + _CHANGED_SQL + ",found AS (SELECT term, count(*)::BIGINT AS n FROM postings GROUP BY term)\nSELECT term, n, n_docs, total_len FROM found, stats")
def fts_counts_after_change(spark, sf_dir):
    """How many documents hold each term, and the statistics, as carried on by the change and not counted anew."""
    index = _changed_index(spark, sf_dir)
    return index.terms().groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0").withColumns({"n_docs": F.lit(index.n_docs).cast("long"), "total_len": F.lit(index.total_len).cast("long")})


_RELAXED = """
c1 AS (SELECT * FROM h1 WHERE {w} ORDER BY score, entity_type, entity_id LIMIT 20), c2 AS (SELECT * FROM h2 WHERE {w} ORDER BY score, entity_type, entity_id LIMIT 20), c3 AS (SELECT * FROM h3 WHERE {w} ORDER BY score, entity_type, entity_id LIMIT 20),
chosen AS (SELECT * FROM c1 WHERE (SELECT count(*) FROM c1) >= 3 UNION ALL SELECT * FROM c2 WHERE (SELECT count(*) FROM c1) < 3 AND (SELECT count(*) FROM c2) >= 3
  UNION ALL SELECT * FROM c3 WHERE (SELECT count(*) FROM c1) < 3 AND (SELECT count(*) FROM c2) < 3)"""


def _relaxed_sql(groups: list[list[str]], where: str = "true") -> tuple[str, ...]:
    return _hits_sql("h1", groups, True), _hits_sql("h2", groups, False), _hits_sql("h3", groups, False, True), _RELAXED.format(w=where)


@query(_with(_OUT + "chosen", *_relaxed_sql([["gear"], ["zznothing"]])))
def fts_relaxed(spark, sf_dir):
    """No document has both words, so either will do."""
    _, docs, index = _index(spark, sf_dir)
    return search.relaxed(index, "gear zznothing")


@query(_with(_OUT + "chosen", *_relaxed_sql([["eventn"], ["suppl"]])))
def fts_relaxed_prefix(spark, sf_dir):
    """No document has either word, so words that begin so will do."""
    _, docs, index = _index(spark, sf_dir)
    return search.relaxed(index, "eventn suppl")


@query(_with(_OUT + "h WHERE entity_type = 'module' " + _TOP + "20", _hits_sql("h", [["economy"]], True)))
def fts_type_coarse(spark, sf_dir):
    _, docs, index = _index(spark, sf_dir)
    return search.ranked(index, "ECONOMY", wanted="module")


@query(_with(_OUT + "h WHERE sub_type ILIKE 'Schema' " + _TOP + "20", _hits_sql("h", [["economy"]], True)))
def fts_type_granular(spark, sf_dir):
    _, docs, index = _index(spark, sf_dir)
    return search.ranked(index, "ECONOMY", wanted="Schema")


_CARDS = """
cards AS (
  SELECT 'repo' AS entity_type, 'repo' AS sub_type, id AS entity_id, name, name AS repo, NULL AS file_path, description FROM repos
  UNION ALL SELECT 'module', coalesce(m.type, 'module'), m.id, m.name, r.name, f.path, m.summary FROM modules m JOIN repos r ON r.id = m.repo_id LEFT JOIN files f ON f.id = m.file_id
  UNION ALL SELECT 'event', 'event', e.id, e.name, r.name, e.source_file, e.schema_definition FROM model_events e JOIN repos r ON r.id = e.repo_id
  UNION ALL SELECT 'service', service_type, s.id, s.name, r.name, NULL, s.description FROM services s JOIN repos r ON r.id = s.repo_id),
search_cards AS (SELECT * FROM cards
  UNION ALL SELECT 'field', parent_type, f.id, field_name, r.name, source_file, parent_type || ' ' || field_type || ' ' || CASE WHEN nullable THEN 'nullable' ELSE 'required' END FROM fields f JOIN repos r ON r.id = f.repo_id
  UNION ALL SELECT 'learned_fact', 'learned_fact', id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END, coalesce(repo, 'user-knowledge'), NULL, content FROM facts),
exact_cards AS (SELECT * FROM cards
  UNION ALL SELECT 'field', parent_type, f.id, field_name, r.name, source_file, parent_type || ' ' || parent_name || '.' || field_name || ': ' || field_type || ' (' || CASE WHEN nullable THEN 'nullable' ELSE 'required' END || ')' FROM fields f JOIN repos r ON r.id = f.repo_id),
name_cards AS (SELECT 'repo' AS entity_type, id AS entity_id, name FROM repos UNION ALL SELECT 'module', id, name FROM modules UNION ALL SELECT 'event', id, name FROM model_events
  UNION ALL SELECT 'service', id, name FROM services UNION ALL SELECT 'file', id, path FROM files UNION ALL SELECT 'field', id, field_name FROM fields),
rels AS (
  SELECT source_type AS entity_type, source_id AS entity_id, 'outgoing' AS direction, relationship_type AS type, target_type AS other_type, n.name AS other_name, e.id AS edge_id FROM edges e JOIN name_cards n ON n.entity_type = e.target_type AND n.entity_id = e.target_id
  UNION ALL SELECT target_type, target_id, 'incoming', relationship_type, source_type, n.name, e.id FROM edges e JOIN name_cards n ON n.entity_type = e.source_type AND n.entity_id = e.source_id)"""

_NEXT = "CASE entity_type WHEN 'field' THEN 'kb_field_impact' WHEN 'repo' THEN 'kb_explain' WHEN 'learned_fact' THEN 'kb_search' ELSE 'kb_entity' END AS next_action"
_SHOWN = f"SELECT h.entity_type, h.sub_type, h.entity_id, c.name, c.repo, c.file_path, coalesce(c.description, c.name) AS snippet, h.score, {_NEXT.replace('entity_type', 'h.entity_type')} FROM {{0}} h JOIN search_cards c ON c.entity_type = h.entity_type AND c.entity_id = h.entity_id"


@query(_with(_SHOWN.format("chosen"), _CARDS, *_relaxed_sql([["blue"], ["bolt"]])))
def search_text_hydrated(spark, sf_dir):
    model, docs, index = _index(spark, sf_dir)
    return search.search_text(model, docs, "blue bolt", index=index)


@query(_with(_SHOWN.format("(SELECT * FROM h " + _TOP + "20)") + " WHERE c.repo = 'Supplier#000000001'", _CARDS, _hits_sql("h", [["supplier", "000000001"]], True)))
def fts_repo_post_limit(spark, sf_dir):
    model, docs, index = _index(spark, sf_dir)
    return search.search_text(model, docs, "Supplier#000000001", repo="Supplier#000000001", index=index)


@query(_with(f"SELECT DISTINCT entity_type, {_NEXT} FROM sized"))
def next_action_map(spark, sf_dir):
    return _docs(spark, sf_dir)[1].select("entity_type").distinct().withColumn("next_action", search.next_action(F.col("entity_type")))


@query(_with("SELECT entity_type, sub_type, count(*)::BIGINT AS count FROM sized GROUP BY ALL"))
def list_types(spark, sf_dir):
    return search.available_types(_docs(spark, sf_dir)[1])


_ENTITY = f"WITH {STAR_SQL},{_CARDS}\n"


@query(_ENTITY + "SELECT name AS query, entity_type, sub_type, entity_id, name, repo, file_path, description FROM exact_cards WHERE entity_type <> 'field' AND name IN (SELECT name FROM modules UNION SELECT name FROM repos)")
def entity_exact(spark, sf_dir):
    """All cards of all module and repository names at once."""
    model = star_model(spark, sf_dir)
    names = model.modules.select(F.col("name").alias("query")).union(model.repos.select("name"))
    return entities.exact_entities(model, names).filter("entity_type <> 'field'")


@query(_ENTITY + "SELECT c.name AS query, entity_type, sub_type, entity_id, c.name, repo, file_path, CASE WHEN s.n >= 2 THEN '[shared across ' || s.n || ' repos] ' ELSE '' END || description AS description FROM exact_cards c JOIN (SELECT field_name, count(DISTINCT repo_id) AS n FROM fields GROUP BY 1) s ON s.field_name = c.name WHERE entity_type = 'field'")
def entity_shared_fields(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return entities.exact_entities(model, model.fields.select(F.col("field_name").alias("query")), "field")


@query(_ENTITY + "SELECT * FROM rels")
def entity_relationships(spark, sf_dir):
    return entities.relationships(star_model(spark, sf_dir))


@query(_ENTITY + "SELECT entity_type, entity_id, name, repo FROM search_cards c WHERE EXISTS (SELECT 1 FROM rels r WHERE r.entity_type = c.entity_type AND r.entity_id = c.entity_id AND r.type = 'routes_to')")
def entity_relationship_filter(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return entities.with_relationships(model, entities.entity_cards(model), "routes_to").select("entity_type", "entity_id", "name", "repo")


@query(_ENTITY + "SELECT * FROM name_cards")
def name_dim_lookup(spark, sf_dir):
    return entities.name_cards(star_model(spark, sf_dir))


@query(_ENTITY + "SELECT entity_type, sub_type, entity_id, name, repo, file_path, description FROM exact_cards WHERE name = 'Supplier#000000007'")
def find_entity(spark, sf_dir):
    model, docs, index = _index(spark, sf_dir)
    return entities.find_entities(model, docs, "Supplier#000000007", index=index).drop("relationships")


@query(_with("SELECT c.entity_type, c.sub_type, c.entity_id, c.name, c.repo, c.file_path, c.description FROM (SELECT * FROM h WHERE entity_type = 'module' " + _TOP + "20) h JOIN search_cards c ON c.entity_type = h.entity_type AND c.entity_id = h.entity_id", _CARDS, _hits_sql("h", [["red"], ["plate"]], True)))
def find_entity_fallback(spark, sf_dir):
    """No entity has this very name, so the ranked search answers."""
    model, docs, index = _index(spark, sf_dir)
    return entities.find_entities(model, docs, "red plate", wanted="module", index=index).drop("relationships")
