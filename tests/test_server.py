"""The tool server: messages in, answers out, with a knowledge base of canned answers."""

import io
import json

from quarry import server
from quarry.api import Knowledge, tool


class Canned(Knowledge):
    def __init__(self):
        pass

    @tool
    def kb_trace(self, start: str, end: str) -> str:
        if start == "nowhere":
            raise ValueError("Service not found: nowhere")
        return f"{start} to {end}"


def ask(*messages):
    sink = io.StringIO()
    server.serve(Canned(), io.StringIO("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages) + "\n"), sink)
    return [json.loads(line) for line in sink.getvalue().splitlines()]


def request(number, method, **params):
    return {"jsonrpc": "2.0", "id": number, "method": method, "params": params}


def test_a_session():
    first, ping, listed, traced, failed = ask(
        request(1, "initialize", protocolVersion="2025-03-26"),
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        request(2, "ping"),
        request("x", "tools/list"),
        request(4, "tools/call", name="kb_trace", arguments={"start": "a", "end": "b"}),
        request(5, "tools/call", name="kb_trace", arguments={"start": "nowhere", "end": "b"}),
    )
    assert first["result"]["protocolVersion"] == "2025-03-26" and first["result"]["serverInfo"]["name"] == "quarry"
    assert ping == {"jsonrpc": "2.0", "id": 2, "result": {}}
    by = {t["name"]: t for t in listed["result"]["tools"]}
    assert listed["id"] == "x" and set(by) == set(Knowledge.TOOLS) == set(server.PURPOSE) and len(by) == 13
    assert by["kb_search"]["inputSchema"]["required"] == ["query"] and by["kb_search"]["inputSchema"]["properties"]["limit"] == {"type": "integer"}
    assert by["kb_reindex"]["inputSchema"]["properties"]["repos"] == {"type": "array", "items": {"type": "string"}}
    assert traced["result"] == {"content": [{"type": "text", "text": "a to b"}], "isError": False}
    assert failed["result"] == {"content": [{"type": "text", "text": "Error in kb_trace: Service not found: nowhere"}], "isError": True}


def test_bad_messages():
    broken, none, unknown, tool_, missing = ask(
        "{not json", {"id": 1}, request(2, "resources/list"), request(3, "tools/call", name="kb_none"), request(4, "tools/call", name="kb_trace", arguments={"start": "a", "stop": "b"})
    )
    assert [m["error"]["code"] for m in (broken, none, unknown, tool_, missing)] == [-32700, -32600, -32601, -32602, -32602]
    assert missing["error"]["message"] == "kb_trace: unknown argument stop, missing argument end"
