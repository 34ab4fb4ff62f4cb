"""Names, lists and patterns that decide what is recognised. They are facts of the recognised formats."""

#: Files that mark a directory as a project, and directories that are never walked.
PROJECT_MARKERS = ("mix.exs", "package.json", "Gemfile", "Cargo.toml", "go.mod")
SKIPPED_DIRS = ("node_modules", ".git", "_build", "deps", "vendor", "dist", ".elixir_ls")

#: Files and top-level directories that a repository's card lists.
KEY_FILES = ("README.md", "CLAUDE.md", "AGENTS.md", "mix.exs", "package.json", "Gemfile", "Cargo.toml", "go.mod")
KEY_DIRS = ("lib", "priv", "test", "tests", "proto", "src", "apps", "config")

#: Dependencies that a repository's technology list names.
ELIXIR_DEPS = ("phoenix", "ecto", "absinthe", "broadway", "oban", "commanded", "eventstore", "grpc")
NODE_DEPS = ("express", "fastify", "next", "react", "vue", "angular", "nestjs")

#: Module attributes that never hold field names.
PLAIN_ATTRIBUTES = (
    "moduledoc", "doc", "derive", "behaviour", "behavior", "impl", "type", "typep", "spec", "callback", "optional_callbacks",
    "compile", "external_resource", "dialyzer", "on_definition", "before_compile", "after_compile", "on_load", "vsn",
)

#: Domains, with their subdomains, that are no services of one's own.
EXTERNAL_DOMAINS = (
    "google.com", "googleapis.com", "openai.com", "adyen.com", "stripe.com", "twilio.com", "sendgrid.com", "sendgrid.net", "amazonaws.com", "github.com",
    "slack.com", "facebook.com", "twitter.com", "braintreegateway.com", "paypal.com", "mailgun.net", "mailchimp.com", "sentry.io", "datadoghq.com", "newrelic.com",
    "pagerduty.com", "auth0.com", "okta.com", "intercom.io", "segment.io", "segment.com", "mixpanel.com", "amplitude.com", "cloudflare.com", "heroku.com",
    "vercel.com", "netlify.com", "firebase.com", "firebaseio.com", "apple.com", "microsoft.com", "zoom.us",
)

#: Name parts of a qualified RPC module that are no domain.
RPC_NOISE_BEFORE = ("Protobuf", "Proto", "Grpc", "Rpc")
RPC_NOISE_AFTER = ("RPCService", "Stub", "ClientBehaviour")

#: Paths of library sources, of tests, and of gateway service files.
LIB_PATH = r"^(src/)?(apps/[^/]+/)?lib/"
TEST_PATH = r"(^|/)(test|spec)/|_test\.exs?$"
GATEWAY_PATH = r"^compose/services/[\w-]+\.ts$"

MAX_FILE_BYTES, README_CHARS = 512_000, 2000

#: Java patterns over a file's content.
HANDLED_STRUCT = r"def\s+handle_(?:event|message)\s*\(%(\w+(?:\.\w+)*)\{"
DECODED_STRUCT = r"def\s+handle_decoded_message\s*\([^)]*%(\w+(?:\.\w+)*)\{"
TOPIC_KEY = r'"([\w.-]+)"\s*=>\s*%\{'
SCHEMA_REF = r"schema:\s+(\w+(?:\.\w+)*)"
CONSUMER_USE = r"use\s+Kafkaesque\.(?:Consumer|OneOffConsumer)"
MOCKABLE_CLIENT = r"use\s+RpcClient\.MockableRpcClient,\s*behaviour:\s*([\w.]+)"
PLAIN_CLIENT = r"use\s+RpcClient\.Client,\s*service:\s*([\w.]+),\s*stub:\s*([\w.]+)"
TESLA_URL = r'plug\s+Tesla\.Middleware\.BaseUrl,\s*"([^"]+)"'
BASE_URL = r'@base_url\s+"([^"]+)"'
GATEWAY_SERVICE = r'describe\(\{\s*name:\s*"(\w+)"\s*,[\s\S]*?schemaSource:\s*\{\s*repo:\s*"([\w-]+)"'
TOPIC_ATTRIBUTE = r'@topic(?:_name)?\s+"([\w.-]+)"'
PRODUCER_SIGN = r"Kafkaesque\.Producer\.produce_batch|Outbox\.emit|topic_name:"
TOPIC_LIST = r'topics:\s*\["([\w.-]+)"\]'
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\s]+)"

#: Patterns of protocol buffers, and words that are no field types.
PROTO_MESSAGE = r"^message\s+(\w+)\s*\{"
PROTO_SERVICE = r"^service\s+(\w+)\s*\{"
PROTO_FIELD = r"^\s+(?:(repeated|optional|required)\s+)?(\w[\w.]*)\s+(\w+)\s*=\s*\d+"
PROTO_RPC = r"rpc\s+(\w+)\s*\(\s*(\w[\w.]*)\s*\)\s+returns\s+\(\s*(\w[\w.]*)\s*\)"
PROTO_PACKAGE = r"^package\s+([\w.]+)\s*;"
PROTO_NO_TYPES = ("message", "enum", "oneof", "reserved", "option", "extend")

#: Patterns of GraphQL definitions, and the kinds whose bodies declare fields.
GRAPHQL_DEFINITION = r"^(extend\s+)?(type|input|enum|interface)\s+(\w+)(?:\s+implements\s+[\w\s&]+)?\s*\{"
GRAPHQL_UNION = r"^(extend\s+)?union\s+(\w+)\s*=\s*(.+)"
GRAPHQL_SCALAR = r"^scalar\s+(\w+)"
GRAPHQL_FIELD = r"^\s*(\w+)(?:\([^)]*\))?\s*:\s*(\[?\w+!?\]?!?)"
GRAPHQL_FIELD_KINDS = ("type", "input", "interface")

#: Patterns of Elixir modules, and what a module's name says about its kind.
MODULE = r"defmodule\s+([\w.]+)\s+do\b"
DOC_FALSE = r"@moduledoc\s+false\b"
DOC_BLOCK = r'@moduledoc\s+"""([\s\S]*?)"""'
DOC_LINE = r'@moduledoc\s+"([^"]*)"'
DEFINITION = r"^\s+def\s+(\w+)\(([^)]*)\)"
BARE_DEFINITION = r"^\s+def\s+(\w+)\s*(?:,|do\b|when\b)"
TABLE = r'schema\s+"(\w+)"'
SCHEMA = r'\bschema\s+"\w+"\s+do\b'
ECTO_FIELD = r"field[( ]+:(\w+),\s*:?(\w[\w.]*)"
ASSOCIATION = r"(belongs_to|has_many|has_one|many_to_many)[( ]+:(\w+),\s*(\w[\w.]*)"
NAMED_MACRO = r"(object|input_object)\s+:(\w+)\s+do\b"
ROOT_MACRO = r"(query|mutation)\s+do\b"
CLIENT_STUB = r"use\s+RpcClient\.(?:Client|MockableRpcClient)[\s\S]*?stub:\s*(\w+(?:\.\w+)*)"
STUB_CALL = r"(\w+(?:\.\w+)*)\.Stub\.\w+\s*\("
WORD_ATTRIBUTE = r"@(\w+)\s+~w\(([\s\S]*?)\)a"
LIST_ATTRIBUTE = r"@(\w+)\s+\[([\s\S]*?)\]"
# each of the next two reads both forms of a call, a list and an attribute, in one pass
REQUIRED_CALL = r"validate_required\s*\(\s*(?:\w+\s*,\s*)?(?:\[([\s\S]*?)\]|@(\w+)\s*\))"
CAST_CALL = r"\bcast\s*\(\s*(?:\w+\s*,\s*){0,2}(?:\[([\s\S]*?)\]|(@\w+(?:\s*\+\+\s*@\w+)*)\s*\))"
ATOM = r":(\w+)"
ATTRIBUTE = r"@(\w+)"
MODULE_KINDS = (("context", r"Context$|\.Contexts?\."), ("command", r"\.Commands?\.|Command$"), ("query", r"\.Queries?\.|Query$"))

# How names and texts become tokens. A space goes between a lower-case letter or digit and a
# capital, and before the last capital of a run that a lower-case letter follows; whatever is no ASCII letter
# or digit becomes one space. In Spark and in Python alike.
CAMEL, CAPITALS, NO_TOKEN = r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"[^a-zA-Z0-9]+"
