"""From working trees to the stored model: scan, extract, resolve, write, enrich.

Everything of all repositories is one set of DataFrames: git is asked, files are
read and parsed in parallel, names are resolved by joins, and each table is
written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import number_of_key
from quarry.operators import extract, resolve
from quarry.plans.store import Store, modes
from quarry.session import cut
from quarry.sources import catalog, git, repositories


def extracted(files: DataFrame, organizations: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Intermediate tables of a set of files (repo_id, path, content)."""
    modules, messages, types = cut(extract.elixir_modules(files)), cut(extract.proto_messages(files)), cut(extract.graphql_types(files))
    return {
        "elixir": modules,
        "messages": messages,
        "types": types,
        "services": extract.service_rows(extract.proto_services(files)),
        "relationships": extract.event_relationships(files, messages),
        "topology": extract.topology_edges(files, modules, organizations),
    }


def tables_of(repos: DataFrame, files: DataFrame, found: dict[str, DataFrame], known_repos: DataFrame | None = None, known_services: DataFrame | None = None, known_events: DataFrame | None = None, known_modules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of all owned tables. Names also resolve to what is stored of other repositories, if given."""
    ids = repos.select(F.col("id").alias("repo_id"))
    other = lambda stored, new, columns: new.select(*columns) if stored is None else new.select(*columns).unionByName(stored.join(ids, "repo_id", "left_anti").select(*columns))
    modules = cut(extract.module_rows(found["elixir"], found["types"]))
    events = extract.event_rows(found["messages"])
    all_events = other(known_events, events, ("id", "repo_id", "name"))
    event_edges, consumed = resolve.event_links(found["relationships"], all_events)
    events = cut(events.unionByName(consumed))
    services = cut(found["services"])
    fields = cut(resolve.with_parents(extract.field_rows(found["elixir"], found["messages"], found["types"]).dropDuplicates(["id"]), modules, events))
    all_repos = repos.select("id", "name") if known_repos is None else repos.select("id", "name").unionByName(known_repos.select("id", "name")).distinct()
    edges = (
        event_edges.unionByName(resolve.topology_links(found["topology"], all_repos, other(known_services, services, ("id", "repo_id", "name"))))
        .unionByName(resolve.association_links(found["elixir"], other(known_modules, modules, ("id", "repo_id", "name"))))
        .unionByName(resolve.field_links(fields))
    )
    paths = files.select("repo_id", "path").distinct()
    language = F.when(F.col("path").endswith(".ex") | F.col("path").endswith(".exs"), "elixir").when(F.col("path").endswith(".proto"), "proto").when(F.col("path").endswith(".graphql"), "graphql")
    tracked = paths.join(modules.select("repo_id", "path").unionByName(events.select("repo_id", F.col("source_file").alias("path"))).distinct(), ["repo_id", "path"], "left_semi")
    stored_files = tracked.select(number_of_key(F.lit("file"), F.col("repo_id"), F.col("path")).alias("id"), "repo_id", "path", language.alias("language"))
    return {"repos": repos, "files": stored_files, "modules": modules, "services": services, "events": events, "fields": fields, "edges": cut(edges)}


NO_BRANCH, UNCHANGED, ABSENT = "no main or master branch", "no new commits", "no such repository"


def _written(store: Store, work: list[dict], force: bool, organizations: tuple[str, ...]) -> dict[str, str]:
    """Extracts and stores repositories (probes with ``last``) together; returns the mode of each by name."""
    spark = store.spark
    repos = repositories.repository_table(spark, [w["path"] for w in work])
    files = cut(repositories.working_tree(repos))
    stamp = spark.createDataFrame([(w["name"], w["head"], w["branch"]) for w in work], "name string, last_indexed_commit string, default_branch string")
    known = repositories.metadata(repos, files).join(stamp, "name").withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    model = store.model()
    tables = tables_of(cut(known), files, extracted(files, organizations), model.repos, model.services, model.events, model.modules)
    ids = {r["name"]: r["id"] for r in repos.collect()}
    changes = cut(git.parsed_changes(git.diff_lines(spark, [(ids[w["name"]], w["path"], w["last"]) for w in work if w["reachable"]])))
    counts = {r["repo_id"]: r["count"] for r in changes.groupBy("repo_id").count().collect()}
    sizes = {r["repo_id"]: r["count"] for r in files.groupBy("repo_id").count().collect()}
    plan = spark.createDataFrame([(ids[w["name"]], force, w["last"], w["head"] or "", w["reachable"], counts.get(ids[w["name"]], 0), sizes.get(ids[w["name"]], 0)) for w in work], "repo_id long, force boolean, last string, tip string, reachable boolean, changed int, files int")
    mode = {r["repo_id"]: r["mode"] for r in modes(plan).collect()}
    of = lambda kind: [i for i in ids.values() if mode[i] == kind]
    pick = lambda i: {k: v.filter(F.col("id" if k == "repos" else "repo_id").isin(i)) for k, v in tables.items()}
    # one version for everything that is stored of these repositories, the text index and the graph included
    with store.transaction():
        if of("full"):
            store.persist(pick(of("full")), of("full"))
        if of("surgical"):
            store.persist_changed(pick(of("surgical")), changes, of("surgical"))
        store.update_index(list(ids.values()))
        store.update_graph(model, list(ids.values()))
    return {w["name"]: mode[ids[w["name"]]] for w in work}


def _in_halves(store: Store, work: list[dict], force: bool, organizations: tuple[str, ...]) -> tuple[dict[str, str], dict[str, str]]:
    """(mode by name, error by name): all together, and where that fails by halves, so one failing repository costs a logarithm of runs."""
    try:
        return _written(store, work, force, organizations), {}
    except Exception as error:  # noqa: BLE001
        if len(work) == 1:
            return {}, {work[0]["name"]: str(error).splitlines()[0] if str(error) else type(error).__name__}
    middle = len(work) // 2
    parts = [_in_halves(store, half, force, organizations) for half in (work[:middle], work[middle:])]
    return parts[0][0] | parts[1][0], parts[0][1] | parts[1][1]


def index_all(
    store: Store, root: str, names: list[str] | None = None, force: bool = False, refresh: bool = False, organizations: tuple[str, ...] = (), progress: Callable[[int, int, str], None] | None = None
) -> list[dict]:
    """Indexes the repositories below ``root``; one result per repository: its mode, why it is skipped, or what stopped it.

    Repositories that are named are indexed whatever their commits are. Others are skipped without a
    main or master branch and without new commits. All are extracted together; if that fails, they
    are tried by halves, so one that cannot be indexed leaves the others alone. A refresh that fails
    is stated in the result, and the repository is indexed as it is. A name that no repository has
    gives a result that says so.
    """
    say = progress or (lambda done, total, name: None)
    wanted = [(p.rsplit("/", 1)[-1], p) for p in repositories.discover(root)]
    wanted = [(n, p) for n, p in wanted if not names or n in names]
    absent = [{"repo": n, "status": "missing", "reason": ABSENT} for n in dict.fromkeys(names or []) if n not in {w for w, _ in wanted}]
    if not wanted:
        return absent
    stored = {r["name"]: r["last_indexed_commit"] for r in store.table("repos").filter(F.col("name").isin([n for n, _ in wanted])).select("name", "last_indexed_commit").collect()}
    results: dict[str, dict] = {}
    work = []
    for found in git.probes(store.spark, [(n, p, stored.get(n)) for n, p in wanted], refresh):
        name = found["name"]
        results[name] = {"repo": name} | ({"refresh_error": found["refresh_error"], "category": git.error_category(found["refresh_error"])} if found["refresh_error"] else {})
        skip = None
        if not force and not names:
            skip = NO_BRANCH if not found["branch"] else UNCHANGED if stored.get(name) and stored[name] == found["tip"] else None
        if skip:
            results[name] |= {"status": "skipped", "mode": "skip", "reason": skip}
        else:
            work.append(found | {"last": stored.get(name)})
    say(len(results) - len(work), len(results), "")
    if work:
        batch, failed = _in_halves(store, work, force, organizations)
        for done, w in enumerate(work, len(results) - len(work) + 1):
            name = w["name"]
            results[name] |= {"status": "error", "error": failed[name], "category": git.error_category(failed[name])} if name in failed else {"status": "success", "mode": batch[name]}
            say(done, len(results), name)
        if batch:
            try:
                enrich(store, root)
            except Exception as error:  # noqa: BLE001
                # what was indexed is stored; only domains and owners are as they were
                for name in batch:
                    results[name]["enrich_error"] = str(error).splitlines()[0] if str(error) else type(error).__name__
            store.grow()
            store.vacuum()
    return [results[n] for n, _ in wanted] + absent


def enrich(store: Store, root: str) -> int:
    """Sets domain and owner of stored events from a catalog below ``root``; returns how many it touched."""
    place = catalog.find_catalog(root)
    texts = catalog.catalog_files(place) if place else []
    if not texts:
        return 0
    found = cut(catalog.entries(store.spark.createDataFrame(texts, "kind string, ord int, text string")))
    domains = resolve.event_domains(catalog.domain_rows(found), catalog.service_rows(found))
    events = store.table("events")
    rows = cut(resolve.enriched_events(events, catalog.event_rows(found), domains))
    touched = resolve.catalog_matches(catalog.event_rows(found), rows).select("event_id").distinct().count()
    # only repositories whose events got another domain or owner are written
    stated = lambda df: df.select("id", "repo_id", "domain", "owner_team")
    ids = [r["repo_id"] for r in stated(rows).exceptAll(stated(events)).select("repo_id").distinct().collect()]
    if ids:
        store.persist({"events": rows.filter(F.col("repo_id").isin(ids))}, ids)
    return touched
