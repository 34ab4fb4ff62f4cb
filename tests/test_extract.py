from quarry.operators import extract, parsers, resolve
from quarry.schema import model_of

ELIXIR = '''
defmodule Shop.Orders.Order do
  @moduledoc """
  An order.
  """
  use Ecto.Schema
  @required [:total, :state]
  @optional ~w(note
    tag)a

  schema "orders" do
    field :total, :decimal
    field(:state, Ecto.Enum, values: [:a])
    field :note, :string
    belongs_to :customer, Shop.Customer
    has_many(:lines, Shop.Line)
    embeds_one :x, X do
      field :inner, :string
    end
  end

  def changeset(order, params) do
    order |> cast(params, @required ++ @optional) |> validate_required(@required)
    cast(order, params, [:extra])
  end

  def all, do: []
  def all(x), do: x
  defp hidden(x), do: x
end

defmodule Shop.OrdersContext do
  @moduledoc false
  use RpcClient.Client, service: Acme.Pay.Protobuf.Rpc.V1.PayService, stub: Acme.Pay.Protobuf.Rpc.V1.PayService.Stub
  def go(c), do: Rpc.Ship.V1.RPCService.Stub.send(c)
  object :thing do
  end
  query do
  end
end
'''


def test_elixir_modules():
    order, context = parsers.elixir_modules(ELIXIR)
    assert (order["name"], order["type"], order["table_name"], order["moduledoc"]) == ("Shop.Orders.Order", "schema", "orders", "An order.")
    assert order["schema_fields"] == [{"name": "total", "type": "decimal"}, {"name": "state", "type": "Ecto.Enum"}, {"name": "note", "type": "string"}, {"name": "inner", "type": "string"}]
    assert order["associations"] == [{"kind": "belongs_to", "name": "customer", "target": "Shop.Customer"}, {"kind": "has_many", "name": "lines", "target": "Shop.Line"}]
    assert order["required_fields"] == ["total", "state"] and order["optional_fields"] == ["extra", "note", "tag"]
    assert order["functions"] == ["all/1", "changeset/2"]
    assert (context["type"], context["moduledoc"]) == ("context", None)
    assert context["absinthe_types"] == [{"kind": "object", "name": "thing"}, {"kind": "query", "name": "query"}]
    assert context["grpc_stubs"] == ["Acme.Pay.Protobuf.Rpc.V1.PayService.Stub", "Rpc.Ship.V1.RPCService.Stub"]


def test_module_types():
    for name, want in {"A.B.Context": "context", "A.Contexts.B": "context", "A.Commands.B": "command", "DoCommand": "command", "A.Queries.B": "query", "AQuery": "query", "A.B": "module"}.items():
        assert parsers.module_type(name, None) == want


def test_embedded_schema_has_no_table():
    (m,) = parsers.elixir_modules("defmodule A do\n  embedded_schema do\n    field :x, :string\n  end\nend")
    assert m["table_name"] is None and m["schema_fields"] == []


PROTO = """syntax = "proto3";
package shop.v1;
message Order {
  string id = 1;
  optional int64 total = 2;
  repeated Line lines = 3;
  message Line {
    string sku = 1;
  }
  oneof kind { string a = 4; }
  reserved 9;
}
  message Indented { string x = 1; }
service Orders {
  rpc Get(GetOrder) returns (Order) {}
  rpc Watch(stream GetOrder) returns (stream Order);
}
message Open {
  string x = 1;
"""


def test_proto():
    (m,) = parsers.proto_messages(PROTO)
    assert [(f["name"], f["type"], f["optional"]) for f in m["fields"]] == [("id", "string", False), ("total", "int64", True), ("lines", "Line", False), ("sku", "string", False)]
    (s,) = parsers.proto_services(PROTO)
    assert s == {"name": "Orders", "rpcs": [{"name": "Get", "input": "GetOrder", "output": "Order"}]}
    assert parsers.proto_package(PROTO) == "shop.v1" and parsers.proto_messages("") == []


GRAPHQL = """type Order implements Node & X {
  # comment
  id: ID!
  lines(first: Int): [Line!]!
  note: String
}
extend type Query {
  orders: [Order]
}
input In { a: Int! }
enum Kind { A B }
interface Node { id: ID! }
union Any = A | B
scalar Date
"""


def test_graphql():
    types = parsers.graphql_types(GRAPHQL)
    assert [(t["kind"], t["name"], t["extended"]) for t in types] == [("type", "Order", False), ("type", "Query", True), ("input", "In", False), ("enum", "Kind", False), ("interface", "Node", False), ("union", "Any", False), ("scalar", "Date", False)]
    assert [(f["name"], f["type"], f["nullable"]) for f in parsers.graphql_fields(types[0]["body"])] == [("id", "ID!", False), ("lines", "[Line!]!", False), ("note", "String", True)]


def test_graphql_fields_as_columns_agree(spark):
    files = spark.createDataFrame([(1, "a.graphql", GRAPHQL)], "repo_id long, path string, content string")
    types = extract.graphql_types(files)
    got = {(r.parent_name, r.name, r.type, r.nullable) for r in extract.graphql_fields(types).collect()}
    want = {(t["name"], f["name"], f["type"], f["nullable"]) for t in parsers.graphql_types(GRAPHQL) if t["kind"] in parsers.FIELD_KINDS for f in parsers.graphql_fields(t["body"])}
    assert got == want


def files(spark, *rows):
    return spark.createDataFrame([(r, p, c) for r, p, c in rows], "repo_id long, path string, content string")


def test_paths(spark):
    from pyspark.sql import functions as F

    rows = ["lib/a.ex", "src/lib/a.ex", "apps/x/lib/a.ex", "src/apps/x/lib/a.ex", "deps/lib/a.ex", "lib/test/a.ex", "lib/a_test.exs"]
    got = {r.p: (r.lib, r.test) for r in spark.createDataFrame([(p,) for p in rows], "p string").select("p", extract.lib_path(F.col("p")).alias("lib"), extract.test_path(F.col("p")).alias("test")).collect()}
    assert [got[p][0] for p in rows] == [True, True, True, True, False, True, True]
    assert [got[p][1] for p in rows] == [False, False, False, False, False, True, True]


def test_event_relationships(spark):
    src = 'defmodule H do\n use Kafkaesque.Consumer, x: 1\n def handle_event(%Made{} = e), do: e\n def handle_event(%Made{}), do: 1\n def handle_decoded_message(%{proto_payload: %A.Made{}}), do: 1\n "orders.v1" => %{}\n schema: Payload\n schema: Ev.One\nend'
    f = files(spark, (1, "lib/h.ex", src), (2, "proto/a.proto", "message Made {\n}\n"), (1, "test/h.ex", src))
    rows = {(r.repo_id, r.type, r.event_name, r.handler_module) for r in extract.event_relationships(f, extract.proto_messages(f)).collect()}
    assert rows == {(2, "produces_event", "Made", None), *((1, "consumes_event", n, "H") for n in ("Made", "A.Made", "orders.v1", "Ev.One"))}


def test_rpc_domains(spark):
    from pyspark.sql import functions as F

    cases = {"Rpc.Customers.V1.RPCService": "Customers", "Acme.Customers.Protobuf.Rpc.V1.X": "Customers", "Acme.Protobuf.Rpc.V1.Stock.Stub": "Stock", "Acme.Catalog.Client": "Catalog", "Alone": "Alone", "Rpc": "Rpc"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.d for r in df.select("n", extract.rpc_domain(F.col("n"), ("Acme",)).alias("d")).collect()} == cases


def test_grpc_priority(spark):
    mock = "use RpcClient.MockableRpcClient,\n  behaviour: Rpc.Pay.V1.Behaviour{}"
    plain = "use RpcClient.Client, service: Rpc.Pay.V1.RPCService, stub: Rpc.Pay.V1.RPCService.Stub\nuse RpcClient.Client, service: Rpc.Ship.V1.S, stub: Rpc.Ship.V1.S.Stub"
    f = files(spark, (1, "lib/a.ex", "defmodule A do\n" + plain + "\nend"), (1, "lib/b.ex", "defmodule B do\n" + mock.replace("{}", "1") + "\nend"), (1, "lib/c.ex", "defmodule C do\n" + mock.replace("{}", "2") + "\n x = Rpc.Stock.V1.S.Stub.get(1)\nend"))
    rows = {r.target: r.metadata["pattern"] for r in extract.grpc_edges(f, extract.elixir_modules(f)).collect()}
    assert rows == {"Rpc.Pay.V1.Behaviour2": "mockable", "Rpc.Ship.V1.S": "client", "Rpc.Stock.V1.S.Stub": "direct"}


def test_http_gateway_kafka(spark):
    f = files(
        spark,
        (1, "lib/h.ex", 'plug Tesla.Middleware.BaseUrl, "http://payments.internal:4000"\n@base_url "https://api.stripe.com"\n@base_url "nonsense"\n@base_url "https://User@Stock-svc/x"'),
        (2, "compose/services/a.ts", 'describe({ name: "orders", x: 1, schemaSource: { repo: "app-orders" } })'),
        (3, "lib/k.ex", '@topic "made.v1"\nOutbox.emit(1)\nuse Kafkaesque.OneOffConsumer, c: %{"used.v1" => %{}}\ntopics: ["used.v1"]\ntopics: ["other.v1"]'),
        (4, "lib/k.ex", '@topic_name "quiet.v1"'),
    )
    rows = [(r.repo_id, r.mechanism, r.target, r.metadata.get("role"), r.confidence) for r in extract.topology_edges(f, extract.elixir_modules(f)).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, "http", "payments", None, "low"), (1, "http", "stock-svc", None, "low"), (2, "gateway", "app-orders", None, "medium"), (3, "kafka", "made.v1", "producer", "high"), (3, "kafka", "used.v1", "consumer", "high"), (3, "kafka", "other.v1", "consumer", "high")], key=str
    )


def test_topology_links(spark):
    found = spark.createDataFrame(
        [(1, "http", "lib/a.ex", "pay", {"url": "u"}, "low", 3, 0), (1, "http", "lib/b.ex", "pay", {"url": "v"}, "low", 3, 0), (1, "grpc", "lib/a.ex", "Rpc.X.PayService", {}, "high", 0, 0), (1, "grpc", "lib/a.ex", "Nobody", {}, "high", 0, 1), (1, "kafka", "lib/k.ex", "t.v1", {"role": "consumer", "topic": "t.v1"}, "high", 5, 0)],
        "repo_id long, mechanism string, path string, target string, metadata map<string,string>, confidence string, kind int, nth int",
    )
    m = model_of(spark, repos=[{"id": 1, "name": "app"}, {"id": 2, "name": "app-pay"}, {"id": 3, "name": "app-ship"}], services=[{"id": 9, "repo_id": 3, "name": "PayService"}])
    rows = {(r.relationship_type, r.target_type, r.target_id, r.source_file) for r in resolve.topology_links(found, m.repos, m.services).collect()}
    assert rows == {("calls_http", "repo", 2, "lib/a.ex"), ("calls_grpc", "repo", 3, "lib/a.ex"), ("calls_grpc", "service_name", 0, "lib/a.ex"), ("consumes_kafka", "service_name", 0, "lib/k.ex")}


def test_front_matter_and_paragraph():
    fm = parsers.front_matter("---\nid: 'event:paid'\nname: \"Paid\"\nsummary: >-\n  long\nowners:\n  - team-a\n  - id: 's:x'\n---\nbody")
    assert fm == {"id": "event:paid", "name": "Paid", "summary": [], "owners": ["team-a", "id: 's:x"]} or fm["owners"][0] == "team-a"
    assert parsers.listed_id("id: 's:x'") == "s:x" and parsers.listed_id("plain") == "plain"
    assert parsers.front_matter("no block") == {}
    assert parsers.first_paragraph("# T\n\n![b](x)\nOne\ntwo\n\nthree") == "One two"
    assert parsers.first_paragraph("plain\ntext") == "plain text" and parsers.first_paragraph("# T\n## H\nx") is None


def test_catalog_strategies(spark):
    events = spark.createDataFrame([(1, "PaymentFailed", "a"), (2, "OldOrderMade", "b"), (3, "Payload", "proto/stock_moved/v1.proto")], "id long, name string, source_file string")
    ids = spark.createDataFrame([("event:payment-failed",), ("event:order-made",), ("event:stock-moved",), ("event:none",)], "catalog_id string")
    assert {(r.catalog_id, r.event_id, r.strategy) for r in resolve.catalog_matches(ids, events).collect()} == {("event:payment-failed", 1, 1), ("event:order-made", 2, 2), ("event:stock-moved", 3, 3)}
