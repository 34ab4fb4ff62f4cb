import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.api import Knowledge
from quarry.cli import main
from quarry.plans import indexing, store
from quarry.schema import model_of
from quarry.sources import catalog, git, repositories
from tests.seed import edge, golden, repo

MIX = 'defp deps do\n [{:phoenix, "~> 1.0"}, {:ecto, "1"}]\nend'


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def commit(folder):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    if not (folder / ".git").exists():
        run("init", "-b", "main")
    run("add", "-A")
    run("commit", "-m", "x", "--allow-empty")


@pytest.fixture()
def root(tmp_path):
    shop, pay = tmp_path / "code" / "app-shop", tmp_path / "code" / "app-pay"
    write(shop / "mix.exs", MIX)
    write(shop / "README.md", "# Shop\n\nSells things.\n\nMore.")
    write(shop / "lib/shop.ex", 'defmodule Shop.Order do\n  schema "orders" do\n    field :total, :decimal\n    belongs_to :line, Shop.Line\n  end\n  plug Tesla.Middleware.BaseUrl, "http://app-pay:80"\nend\ndefmodule Shop.Line do\nend\n')
    write(shop / "lib/_hidden.ex", "defmodule Shop.Hidden do\nend\n")
    write(shop / "proto/o.proto", "message OrderMade {\n  string total = 1;\n}\nservice Orders {\n  rpc Get(A) returns (B);\n}\n")
    write(shop / "node_modules/x/lib/y.ex", "defmodule No do\nend")
    write(pay / "package.json", '{"dependencies": {"react": "1", "@nestjs/core": "2"}}')
    write(pay / "lib/h.ex", "defmodule Pay.Handler do\n  def handle_event(%OrderMade{} = e), do: e\n  def handle_event(%Unknown{}), do: 1\nend\n")
    write(tmp_path / "code" / "not-a-repo" / "mix.exs", "x")
    for p in (shop, pay):
        commit(p)
    return tmp_path / "code"


def test_discovery(root, tmp_path):
    assert [p.rsplit("/", 1)[-1] for p in repositories.discover(str(root))] == ["app-pay", "app-shop"]
    with pytest.raises(FileNotFoundError):
        repositories.discover(str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        repositories.discover(str(root / "app-shop" / "mix.exs"))


def test_working_tree_and_metadata(spark, root):
    repos = repositories.repository_table(spark, repositories.discover(str(root)))
    files = repositories.working_tree(repos, max_bytes=120).cache()
    paths = {r.path: r.content for r in files.filter("repo = 'app-shop'").collect()}
    assert set(paths) == {"mix.exs", "README.md", "lib/shop.ex", "lib/_hidden.ex", "proto/o.proto"}
    assert paths["lib/shop.ex"] is None and paths["mix.exs"] == MIX
    meta = {r["name"]: r for r in repositories.metadata(repos, files).collect()}
    assert (meta["app-shop"]["description"], meta["app-shop"]["stack"]) == ("Sells things.", ["elixir", "phoenix", "ecto"])
    assert meta["app-shop"]["key_files"] == ["README.md", "mix.exs", "lib/", "proto/"]
    assert meta["app-pay"]["stack"] == ["node", "react", "nestjs"]


def test_git_probes(spark, root):
    shop = str(root / "app-shop")
    head = git.current_commit(shop)
    assert git.default_branch(shop) == "main" and git.branch_commit(shop, "main") == head
    assert git.reachable(shop, head) and not git.reachable(shop, "0" * 40)
    assert git.current_commit("/nonexistent") is None and git.name_status(shop, "bad", "main") == ""
    assert git.refresh(shop, "main")["refreshed"] is False
    assert [git.error_category(m) for m in ("fetch timed out", "dirty working tree", "x already checked out", "no branch", "?")] == ["timeout", "dirty_tree", "worktree_conflict", "no_branch", "other"]


def tables(kb):
    return {name: sorted(map(str, (r.asDict() for r in df.drop("created_at", "updated_at", "last_indexed_commit").collect()))) for name, df in kb.model().items()}


def test_index_skip_and_surgical_equals_full(spark, root, tmp_path):
    kb = store.Store(spark, str(tmp_path / "kb"))
    assert {(r["repo"], r["status"], r["mode"]) for r in indexing.index_all(kb, str(root))} == {("app-shop", "success", "full"), ("app-pay", "success", "full")}
    m = kb.model()
    assert {r["name"] for r in m.modules.collect()} == {"Shop.Order", "Shop.Line", "Shop.Hidden", "Pay.Handler"}
    kinds = {(r.relationship_type, r.target_type) for r in m.edges.collect()}
    assert kinds == {("produces_event", "event"), ("consumes_event", "event"), ("calls_http", "repo"), ("belongs_to", "module"), ("maps_to", "field")}
    assert {r["name"]: r.schema_definition for r in m.events.collect()}["Unknown"] == "consumed: Unknown"
    made = m.events.filter("name = 'OrderMade'").first()["id"]
    assert {r.relationship_type for r in m.edges.filter(F.col("target_id") == made).collect()} == {"produces_event", "consumes_event"}
    assert {r["status"] for r in indexing.index_all(kb, str(root))} == {"skipped"}
    # three more files, so that one change is few
    for k in range(3):
        write(root / "app-shop" / f"lib/m{k}.ex", f"defmodule Shop.M{k} do\nend\n")
    commit(root / "app-shop")
    indexing.index_all(kb, str(root), force=True)
    write(root / "app-shop" / "lib/m0.ex", "defmodule Shop.Changed do\nend\n")
    (root / "app-shop" / "lib/m1.ex").unlink()
    commit(root / "app-shop")
    assert {r["repo"]: r.get("mode") for r in indexing.index_all(kb, str(root))} == {"app-pay": "skip", "app-shop": "surgical"}
    surgical = tables(kb)
    other = store.Store(spark, str(tmp_path / "kb2"))
    indexing.index_all(other, str(root))
    assert surgical == tables(other)


def test_which_repositories_are_indexed(spark, root, tmp_path, monkeypatch):
    kb = store.Store(spark, str(tmp_path / "kb"))
    subprocess.run(["git", "-C", str(root / "app-pay"), "branch", "-m", "main", "trunk"], check=True)
    got = {r["repo"]: r for r in indexing.index_all(kb, str(root))}
    assert got["app-pay"] == {"repo": "app-pay", "status": "skipped", "mode": "skip", "reason": indexing.NO_BRANCH} and got["app-shop"]["status"] == "success"
    # a repository that is named is indexed without a branch and without new commits
    got = indexing.index_all(kb, str(root), names=["app-pay"])
    assert [(r["repo"], r["status"]) for r in got] == [("app-pay", "success")]
    assert [(r["repo"], r["status"]) for r in indexing.index_all(kb, str(root), names=["app-shop"])] == [("app-shop", "success")]
    # a refresh that fails is one result with what stood in its way
    got = indexing.index_all(kb, str(root), names=["app-shop"], refresh=True)
    assert [(r["status"], r["refresh_error"], r["category"]) for r in got] == [("success", "fetch failed or timed out", "timeout")]
    # changes are those up to HEAD, also where another branch is checked out
    subprocess.run(["git", "-C", str(root / "app-shop"), "checkout", "-q", "-b", "work"], check=True)
    write(root / "app-shop" / "lib/new.ex", "defmodule Shop.New do\nend\n")
    last = git.current_commit(str(root / "app-shop"))
    commit(root / "app-shop")
    assert [tuple(r) for r in git.diff_lines(spark, [(7, str(root / "app-shop"), last)]).collect()] == [(7, "A\tlib/new.ex")]


def test_a_failing_repository_leaves_the_others_alone(spark, root, tmp_path, monkeypatch):
    kb, real, seen = store.Store(spark, str(tmp_path / "kb")), indexing._written, []

    def broken(store_, work, *rest):
        if any(w["name"] == "app-pay" for w in work):
            raise ValueError("cannot parse this")
        return real(store_, work, *rest)

    monkeypatch.setattr(indexing, "_written", broken)
    got = {r["repo"]: r for r in indexing.index_all(kb, str(root), progress=lambda *step: seen.append(step))}
    assert got["app-shop"] == {"repo": "app-shop", "status": "success", "mode": "full"}
    assert got["app-pay"] == {"repo": "app-pay", "status": "error", "error": "cannot parse this", "category": "other"}
    assert seen[0] == (0, 2, "") and [s[:2] for s in seen[1:]] == [(1, 2), (2, 2)]
    assert {r["name"] for r in kb.model().repos.collect()} == {"app-shop"}
    from quarry.cli import index_summary

    assert index_summary(list(got.values())) == "1 indexed, 0 skipped, 1 failed\napp-pay: cannot parse this (other)"


def test_catalog_enrichment(spark, root, tmp_path):
    src = root / "my-event-catalog" / "src"
    write(src / "domains/d/index.mdx", "---\nid: d\nname: Sales\nservices:\n  - id: 's:shop'\n---\n")
    write(src / "services/s/index.mdx", "---\nid: 's:shop'\nsends:\n  - id: 'event:order-made'\n---\n")
    write(src / "events/e/index.mdx", "---\nid: 'event:order-made'\nowners:\n  - team-a\n  - team-b\n---\n")
    assert catalog.find_catalog(str(root)) == str(src) and catalog.find_catalog(str(tmp_path / "none")) is None
    kb = store.Store(spark, str(tmp_path / "kb"))
    indexing.index_all(kb, str(root))
    for _ in range(2):
        r = kb.table("events").filter("name = 'OrderMade'").first()
        assert (r.domain, r.owner_team) == ("Sales", "team-a")
        assert indexing.enrich(kb, str(root)) == 1
    assert kb.table("events").count() == 2


def test_facts_survive_a_schema_change(spark, tmp_path, monkeypatch):
    kb = store.Store(spark, str(tmp_path / "kb"))
    kb.persist({"repos": golden(spark).repos}, [1, 2])
    fact = kb.learn("remember", "a")
    monkeypatch.setattr(store, "SCHEMA_VERSION", 11)
    later = store.Store(spark, str(tmp_path / "kb"))
    assert later.table("repos").count() == 0 and later.table("learned_facts").first().content == "remember"
    assert later.forget(fact) and not later.forget(fact)
    assert later.table("learned_facts").count() == 0


def test_prune_deletes_what_leads_to_a_repository(spark, tmp_path):
    kb = store.Store(spark, str(tmp_path / "kb"))
    m = model_of(spark, repos=[repo(1, "a"), repo(2, "b")], edges=[edge(1, 1, 2, "calls_grpc"), edge(2, 2, 1, "calls_grpc"), edge(3, 1, 1, "calls_http")])
    kb.persist({"repos": m.repos, "edges": m.edges}, [1, 2])
    assert kb.prune(["b"]) == 1 and kb.prune(["b"]) == 0
    assert [r["name"] for r in kb.table("repos").collect()] == ["a"] and [r["id"] for r in kb.table("edges").collect()] == [3]


def test_stale_facts(spark):
    now = F.lit("2024-04-01 00:00:00").cast("timestamp")
    df = spark.sql("SELECT 1L AS id, timestamp'2024-01-02 00:00:00' AS created_at UNION ALL SELECT 2L, timestamp'2024-01-01 00:00:00' UNION ALL SELECT 3L, timestamp'2024-01-01 23:59:59'")
    assert {r.id for r in store.stale_facts(df, 90, now).collect()} == {2, 3}


def test_modes(spark):
    rows = [(1, False, "a", "b", True, 1, 4), (2, True, "a", "b", True, 1, 4), (3, False, None, "b", True, 1, 4), (4, False, "a", "b", False, 1, 4), (5, False, "a", "b", True, 3, 4), (6, False, "a", "b", True, 0, 4), (7, False, "a", "b", True, 201, 1000), (8, False, "a", "b", True, 200, 400)]
    df = spark.createDataFrame(rows, "repo_id long, force boolean, last string, tip string, reachable boolean, changed int, files int")
    assert {r.repo_id for r in store.modes(df).filter("mode = 'surgical'").collect()} == {1, 8}


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    s = store.Store(spark, str(tmp_path_factory.mktemp("kb")))
    m = golden(spark)
    s.persist({k: v for k, v in m.items() if k in store.OWNED and k != "repos"} | {"repos": m.repos}, [1, 2])
    edges = m.edges
    s.persist({"edges": edges}, [1, 2])
    return Knowledge(s)


def test_stored_index_answers_like_a_fresh_one(kb):
    ask = ("booking cancellation", "gateway zzz", "paymen zzz", "payments-service", "Stripe")
    fresh = [kb.search(q) for q in ask]
    kb.store.write_index()
    kb.reload()
    assert [kb.search(q) for q in ask] == fresh and any(fresh)
    fact = kb.learn("zanzibar is far")["id"]
    assert [r["entity_id"] for r in kb.search("zanzibar")] == [fact]
    kb.forget(fact)
    assert kb.search("zanzibar") == []


def test_tools(kb):
    import json

    assert json.loads(kb.kb_search("booking")["text"])["total"] >= 2
    assert json.loads(kb.kb_entity("payments-service")["text"])["data"][0]["name"] == "payments-service"
    assert json.loads(kb.kb_deps("payments-service")["text"])["data"][0]["dependencies"][0]["name"] == "booking-service"
    assert json.loads(kb.kb_impact("booking-service")["text"])["direct"] == {"payments-service": ["grpc"]}
    assert json.loads(kb.kb_trace("payments-service", "booking-service")["text"])["hop_count"] == 1
    assert json.loads(kb.kb_explain("booking-service")["text"])["called_by"] == {"grpc": ["payments-service"]}
    assert json.loads(kb.kb_field_impact("guest_name")["text"])["boundaries"][0]["proto"] == "BookingCreated"
    assert "module" in json.loads(kb.kb_list_types()["text"])["data"][0]
    assert json.loads(kb.kb_status()["text"])["data"][0]["repos"] == 2
    fact = json.loads(kb.kb_learn("a fact", "x")["text"])["data"][0]["id"]
    assert json.loads(kb.kb_forget(fact)["text"])["data"] == [{"deleted": True}]
    assert json.loads(kb.kb_cleanup()["text"])["data"][0]["deleted_repos"] == ["booking-service", "payments-service"]
    assert len(kb.TOOLS) == 13 and all(callable(getattr(kb, t)) for t in kb.TOOLS)


def test_tool_errors(kb):
    assert kb.kb_impact("nobody") == {"text": "Error in kb_impact: Service not found: nobody", "is_error": True}
    assert "Services not found: a, b" in kb.kb_trace("a", "b")["text"]
    assert kb.kb_search("x", limit=51)["is_error"] and kb.kb_deps("x", depth=11)["is_error"]
    assert "Invalid mechanism" in kb.kb_impact("booking-service", "carrier-pigeon")["text"]
    assert kb.kb_reindex([])["is_error"]


def test_command_line(kb, capsys):
    assert main(["search", "booking", "--limit", "2"], kb) == 0 and '"entity_id"' in capsys.readouterr().out
    assert main(["search"], kb) == 1 and "MISSING_QUERY" in capsys.readouterr().err
    assert main(["deps", "payments-service", "--mechanism", "x"], kb) == 1 and "INVALID_MECHANISM" in capsys.readouterr().err
    assert main(["trace", "payments-service", "nobody"], kb) == 1 and "TRACE_ERROR" in capsys.readouterr().err
    assert main(["explain", "nobody"], kb) == 1 and "EXPLAIN_ERROR" in capsys.readouterr().err
    assert main(["forget", "x"], kb) == 1 and "INVALID_ID" in capsys.readouterr().err
    assert main(["forget", "5"], kb) == 1 and "NOT_FOUND" in capsys.readouterr().err
    for argv in (["status"], ["impact", "booking-service"], ["field-impact", "guest_name"], ["learned"], ["docs"], ["search", "--list-types"], ["search", "BookingCreated", "--entity"], ["trace", "payments-service", "booking-service", "--timing"]):
        assert main(argv, kb) == 0


def test_a_run_that_dies_between_tables_leaves_the_former_version(spark, tmp_path, monkeypatch):
    m = golden(spark)
    kb = store.Store(spark, str(tmp_path / "kb"))
    kb.persist(dict(m.items()), [1, 2])
    kb.write_index()
    kb.write_graph()
    before, reader = tables(kb), store.Store(spark, str(tmp_path / "kb"))
    later = m.with_tables(modules=m.modules.withColumn("name", F.lit("new")), edges=m.edges.limit(0))
    real = store.Store._put

    def dying(self, name, *rest):
        real(self, name, *rest)
        if name == "modules":
            raise KeyboardInterrupt

    monkeypatch.setattr(store.Store, "_put", dying)
    with pytest.raises(KeyboardInterrupt):
        kb.persist(dict(later.items()), [1, 2])
    monkeypatch.undo()
    # in this process, for who had opened it, and for who opens it now
    assert tables(kb) == tables(reader) == tables(store.Store(spark, str(tmp_path / "kb"))) == before
    kb.persist(dict(later.items()), [1, 2])
    assert {r["name"] for r in kb.table("modules").collect()} == {"new"} and tables(reader) == before
    assert kb.vacuum(keep=1) > 0 and {r["name"] for r in kb.table("modules").collect()} == {"new"}
    assert kb.index()[0].count() > 0 and kb.edges().count() > 0


def test_a_second_writer_gets_an_error(spark, tmp_path):
    m = golden(spark)
    one, two = (store.Store(spark, str(tmp_path / "kb")) for _ in range(2))
    one.persist({"repos": m.repos}, [1, 2])
    with pytest.raises(FileExistsError):
        two.persist({"repos": m.repos}, [1, 2])
    two.refresh()
    two.persist({"edges": m.edges}, [1, 2])
    one.refresh()
    assert one.table("edges").count() == 3 and one.table("repos").count() == 2


def test_buckets_grow_with_the_tables(spark, tmp_path):
    kb = store.Store(spark, str(tmp_path / "kb"), buckets=2)
    repos = spark.range(1, 60).select("id", F.concat(F.lit("r"), "id").alias("name"))
    kb.persist({"repos": repos}, list(range(1, 60)))
    assert kb.grow() == 2 and kb.grow(bucket_bytes=500) >= 4
    assert kb.table("repos").count() == 59 and store.Store(spark, str(tmp_path / "kb")).state["buckets"] >= 4
    kb.clear("repos", [7])
    assert kb.table("repos").count() == 58


def test_index_and_graph_follow_an_index_run(spark, root, tmp_path):
    kb = store.Store(spark, str(tmp_path / "kb"))
    indexing.index_all(kb, str(root))
    write(root / "app-pay" / "lib/h.ex", "defmodule Pay.Other do\n  plug Tesla.Middleware.BaseUrl, \"http://app-shop:80\"\nend\n")
    commit(root / "app-pay")
    assert [r["repo"] for r in indexing.index_all(kb, str(root), names=["app-pay", "nobody"])] == ["app-pay", "nobody"]
    fresh = store.Store(spark, str(tmp_path / "kb2"))
    fresh.persist({n: kb.table(n) for n in store.OWNED}, [r["id"] for r in kb.table("repos").select("id").collect()])
    fresh.write_index()
    fresh.write_graph()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(kb.index()[0].drop("digest")) == rows(fresh.index()[0].drop("digest"))
    for kind in ("out", "in", "upstream", "downstream"):
        assert rows(kb.graph().read(kind)) == rows(fresh.graph().read(kind))
    assert kb._text_index().n_docs == fresh._text_index().n_docs and len(kb._text_index().segments) >= 1
