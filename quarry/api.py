"""The tools: thin functions that call operators, bound their arguments and shape the answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import dependencies, entities, explain, field_impact, impact, search, trace
from quarry.plans import indexing, store
from quarry.schema import FILTER_TYPES
from quarry.session import cut
from quarry.shape import compact, field_impact_response, impact_response, list_response, single_response
from quarry.sources import git

HINTS = ("Use kb_impact {0} for the blast radius", "Use kb_deps {0} for dependencies", "Use kb_entity {0} for its card")
SYNCED = 3


class ToolError(ValueError):
    """An answer that says what is wrong with the question."""


def tool(fn: Callable) -> Callable:
    """The answer, or a text that names the tool and the error."""

    @wraps(fn)
    def run(self, *args, **kwargs) -> dict:
        try:
            return {"text": fn(self, *args, **kwargs), "is_error": False}
        except Exception as error:  # noqa: BLE001
            return {"text": f"Error in {fn.__name__}: {error}", "is_error": True}

    return run


def _between(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ToolError(f"{name} must be from {low} to {high}")
    return value


def checked_mechanism(value: str | None) -> str | None:
    if value is not None and value not in FILTER_TYPES:
        raise ToolError(f"Invalid mechanism: {value}. Valid: {', '.join(FILTER_TYPES)}")
    return value


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Knowledge:
    """A store with its index and graph, and the tools over it."""

    def __init__(self, kb: store.Store, root: str | None = None):
        self.store, self.spark, self.root = kb, kb.spark, root
        self.reload()

    def reload(self) -> None:
        """Goes to the store's last version."""
        self.store.refresh()
        self.model = self.store.model()
        self.docs, self.text = self.store.index()
        self.stored, self.edges = self.store.graph(), self.store.edges()

    def _seed(self, name: str) -> DataFrame:
        return self.model.repos.filter(F.col("name") == name).select(F.col("id").alias("seed"))

    def _known(self, *names: str) -> None:
        found = {r["name"] for r in self.model.repos.filter(F.col("name").isin(*names)).select("name").collect()}
        missing = [n for n in dict.fromkeys(names) if n not in found]
        if missing:
            raise ToolError(f"Service not found: {missing[0]}" if len(missing) == 1 else f"Services not found: {', '.join(missing)}")

    # -- plain results

    def search(self, query: str, limit: int = 20, repo: str | None = None, kind: str | None = None) -> list[dict]:
        if not query or not query.strip():
            return []
        return rows(search.search_text(self.model, self.docs, query, limit, repo, kind, self.text).orderBy("score", "entity_type", "entity_id"))

    def entity(self, name: str, kind: str | None = None, relationship: str | None = None, repo: str | None = None) -> list[dict]:
        return rows(entities.find_entities(self.model, self.docs, name, kind, relationship, repo, self.text))

    def deps(self, name: str, direction: str = "upstream", depth: int | str = 1, repo: str | None = None, mechanism: str | None = None) -> dict:
        near = None if self.stored is None else lambda frontier: self.stored.near(direction, frontier, "node")
        found = rows(dependencies.dependencies(self.model, self._seed(name), direction, depth, checked_mechanism(mechanism), repo, near).orderBy("depth", "rank"))
        return {"entity": {"name": name, "type": "repo", "repoName": name}, "dependencies": [{k: d[k] for k in ("name", "type", "mechanism", "confidence", "depth", "path")} for d in found]}

    def impact(self, name: str, mechanism: str | None = None, depth: int = 3) -> dict:
        self._known(name)
        seed, edges, nodes, checked = self._seed(name), self.edges, None, checked_mechanism(mechanism)
        if self.stored is not None:
            nodes = cut(self.stored.upstream(seed, depth, checked))
            edges = self.stored.near("out", nodes, "node")
        entries = impact.impact_entries(self.model, edges, seed, checked, depth, nodes)
        found = rows(entries.orderBy("depth", "node"))
        tiers = {t: [{"name": e["name"], "mechanisms": e["mechanisms"], "confidence": e["confidence"]} for e in found if e["tier"] == t] for t in ("direct", "indirect", "transitive")}
        counts = {t: len(v) for t, v in tiers.items()}
        score = 3 * counts["direct"] + 2 * counts["indirect"] + counts["transitive"]
        mechanisms: dict[str, int] = {}
        for e in found:
            for m in e["mechanisms"]:
                mechanisms[m] = mechanisms.get(m, 0) + 1
        summary = f"{name}: {counts['direct']} direct, {counts['indirect']} indirect, {counts['transitive']} transitive (score: {score})"
        return {"service": name, "summary": summary, "stats": {"total": len(found), "blastRadiusScore": score, "mechanisms": mechanisms}, "tiers": tiers}

    def trace(self, start: str, end: str) -> dict:
        self._known(start, end)
        pairs = self._seed(start).select(F.col("seed").alias("from_id")).join(self._seed(end).select(F.col("seed").alias("to_id")), F.lit(True))
        hops = trace.trace_hops(self.model, self.edges, pairs) if self.stored is None else cut(trace.traced_pairs(self.model, self.stored.walks, pairs))
        found = rows(trace.trace_summaries(self.model, hops, pairs))[0]
        if found["path_summary"] is None:
            raise ToolError(f"No path between {start} and {end}")
        steps = [{k: h[k] for k in ("from", "to", "mechanism", "via") if h[k] is not None} for h in rows(hops.orderBy("step"))]
        return {"from": start, "to": end, "path_summary": found["path_summary"], "hop_count": found["hop_count"], "hops": steps}

    def explain(self, name: str) -> dict:
        self._known(name)
        own = rows(self.model.repos.filter(F.col("name") == name))[0]
        mine = F.col("repo_id") == own["id"]
        groups = explain.connection_groups(explain.connections(self.model, self.edges).filter(mine))
        capped = rows(explain.capped(groups))
        side = lambda s: {g["mechanism"]: g["names"] for g in capped if g["side"] == s}
        events = rows(explain.event_lists(self.model).filter(mine)) or [{"produces": [], "consumes": []}]
        modules = rows(explain.module_groups(self.model).filter(mine).orderBy(F.col("n").desc(), "type"))
        counts = rows(explain.counts(self.model).filter(mine))[0]
        return {
            "name": name, "description": own["description"], "path": own["path"], "summary": rows(explain.connection_summaries(self.model, groups).filter(mine))[0]["summary"],
            "talks_to": side("talks_to"), "called_by": side("called_by"), "events": {k: events[0][k] for k in ("produces", "consumes")},
            "modules": {m["type"]: {"count": m["n"], "top": m["top"]} for m in modules}, "counts": {k: counts[k] for k in ("files", "grpc_services")}, "hints": [h.format(name) for h in HINTS],
        }

    def field_impact(self, name: str) -> dict:
        names = self.spark.createDataFrame([(name,)], "field string")
        found = field_impact.occurrences(self.model, names)
        at = field_impact.boundaries(found)
        return {
            "fieldName": name,
            "origins": rows(field_impact.origins(self.model, self.edges, found).drop("field", "repo_id").orderBy("repo", "parent_type", "parent_name")),
            "boundaries": rows(field_impact.boundary_topics(self.edges, at).orderBy("place").drop("field", "place")),
            "consumers": rows(field_impact.consumers(self.model, self.edges, found).drop("field", "repo_id").orderBy("repo")),
            "summary": rows(field_impact.field_impact_summaries(self.model, self.edges, names))[0]["summary"],
        }

    def types(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in rows(search.available_types(self.docs)):
            out.setdefault(r["entity_type"], []).append({"subType": r["sub_type"], "count": r["count"]})
        return out

    def status(self) -> dict:
        return {"path": self.store.path} | {r["name"]: r["count"] for r in rows(store.status_counts(self.model))}

    def learn(self, content: str, repo: str | None = None) -> dict:
        fact = self.store.learn(content, repo)
        self.reload()
        return {"id": fact, "content": content, "repo": repo}

    def learned(self, repo: str | None = None) -> list[dict]:
        return rows(store.facts_listed(self.model.learned_facts, repo))

    def forget(self, fact_id: int) -> bool:
        gone = self.store.forget(fact_id)
        self.reload()
        return gone

    def index(self, root: str, **how) -> list[dict]:
        results = indexing.index_all(self.store, root, **how)
        self.reload()
        return results

    def synced(self, answer: Callable[[], list[dict]]) -> list[dict]:
        """An answer; where repositories in it have new commits, up to three are indexed and it is asked for again."""
        found = answer()
        if self.root is None:
            return found
        names = {r["repo"] for r in found if r.get("repo")}
        stored = rows(self.model.repos.filter(F.col("name").isin(*names)).select("name", "path", "last_indexed_commit")) if names else []
        stale = [r["name"] for r in stored if (head := git.current_commit(r["path"])) and head != r["last_indexed_commit"]][:SYNCED]
        if not stale:
            return found
        self.index(self.root, names=stale, force=True)
        return answer()

    # -- tools

    @tool
    def kb_search(self, query: str, limit: int = 10, repo: str | None = None, type: str | None = None) -> str:  # noqa: A002
        _between(limit, 1, 50, "limit")
        found = self.synced(lambda: self.search(query, limit, repo, type))
        return list_response(found, lambda shown: f'Found {len(found)} results for "{query}"')

    @tool
    def kb_entity(self, name: str, type: str | None = None, repo: str | None = None) -> str:  # noqa: A002
        found = self.synced(lambda: self.entity(name, type, None, repo))
        return list_response(found, lambda shown: f'Found {len(found)} entities for "{name}"')

    @tool
    def kb_deps(self, name: str, direction: str = "upstream", depth: int = 1, repo: str | None = None, mechanism: str | None = None) -> str:
        found = self.deps(name, direction, _between(depth, 1, 10, "depth"), repo, mechanism)
        return single_response(found, f"{name}: {len(found['dependencies'])} {direction} dependencies")

    @tool
    def kb_impact(self, name: str, mechanism: str | None = None, depth: int = 3) -> str:
        found = self.impact(name, mechanism, _between(depth, 1, 10, "depth"))
        return compact(impact_response(found["summary"], found["stats"], [(t, e["name"], e["mechanisms"]) for t, es in found["tiers"].items() for e in es]))

    @tool
    def kb_trace(self, start: str, end: str) -> str:
        return compact(self.trace(start, end))

    @tool
    def kb_explain(self, name: str) -> str:
        return compact(self.explain(name))

    @tool
    def kb_field_impact(self, name: str) -> str:
        found = self.field_impact(name)
        hop = lambda h, parent: {"repo": h["repo"], parent: h["parent_name"], "type": h["field_type"], "nullable": h["nullable"]}
        consumers = [
            {"repo": c["repo"], "confidence": c["confidence"]}
            | ({"via": {"topic": c["via_topic"], "event": c["via_event"]}} if c["via_event"] else {})
            | {k: c[v] for k, v in (("schema", "parent_name"), ("type", "field_type"), ("nullable", "nullable")) if c[v] is not None}
            for c in found["consumers"]
        ]
        return compact(field_impact_response(name, found["summary"], [hop(o, "schema") for o in found["origins"]], [hop(b, "proto") | {"topics": b["topics"]} for b in found["boundaries"]], consumers))

    @tool
    def kb_list_types(self) -> str:
        found = self.types()
        return single_response(found, f"{sum(map(len, found.values()))} types in {len(found)} groups")

    @tool
    def kb_status(self) -> str:
        found = self.status()
        repos = rows(self.model.repos.orderBy("name").limit(20).select("name", "path"))
        snapshot = git.repo_snapshot(self.spark, [(r["name"], r["path"]) for r in repos]).filter("head is not null")
        return single_response(found | {"staleness": rows(store.staleness(self.model.repos, snapshot))}, f"{found['repos']} repositories")

    @tool
    def kb_learn(self, content: str, repo: str | None = None) -> str:
        fact = self.learn(content, repo)
        return single_response(fact, f"Learned fact {fact['id']}")

    @tool
    def kb_forget(self, id: int) -> str:  # noqa: A002
        gone = self.forget(id)
        return single_response({"deleted": gone}, f"Fact {id} {'deleted' if gone else 'not found'}")

    @tool
    def kb_reindex(self, repos: list[str], refresh: bool = True) -> str:
        if not repos:
            raise ToolError("name at least one repository")
        found = self.index(self.root or ".", names=repos, force=True, refresh=refresh)
        return list_response(found, lambda shown: f"Indexed {len(found)} repositories")

    @tool
    def kb_cleanup(self, prune: bool = False, max_fact_age_days: int = 90) -> str:
        import os

        gone = [r["name"] for r in rows(self.model.repos.select("name", "path")) if not os.path.exists(r["path"])]
        old = rows(store.stale_facts(self.model.learned_facts, max_fact_age_days).select("id", "content", "created_at"))
        if prune and gone:
            self.store.prune(gone)
            self.reload()
        return single_response({"deleted_repos": gone, "pruned": prune, "stale_facts": old}, f"{len(gone)} deleted repositories, {len(old)} stale facts")

    TOOLS = ("kb_search", "kb_entity", "kb_deps", "kb_learn", "kb_forget", "kb_status", "kb_cleanup", "kb_list_types", "kb_reindex", "kb_impact", "kb_trace", "kb_explain", "kb_field_impact")
