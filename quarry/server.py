"""The tools as a server: JSON-RPC 2.0 messages, one a line, on standard input and output.

It speaks the part of the Model Context Protocol that tools need: ``initialize``,
``ping``, ``tools/list`` and ``tools/call``. A tool's input schema follows from
its method's signature; notifications get no answer.
"""

from __future__ import annotations

import inspect
import json
from typing import Any, TextIO

from quarry import __version__
from quarry.api import Knowledge

PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

#: What each tool is for, as clients show it.
PURPOSE = {
    "kb_search": "Ranked text search over all indexed repositories, by kind or repository",
    "kb_entity": "Cards of the entities of a name, with their relationships",
    "kb_deps": "What a service calls, or what calls it, to a depth",
    "kb_learn": "Stores a fact",
    "kb_forget": "Deletes a fact by its id",
    "kb_status": "Counts of what is stored, and which repositories are stale",
    "kb_cleanup": "Repositories whose folder is gone and old facts; deletes the former if asked to",
    "kb_list_types": "All kinds of entities with their counts",
    "kb_reindex": "Indexes named repositories anew, from their remotes if they can be refreshed",
    "kb_impact": "Blast radius: which services a change of one affects",
    "kb_trace": "The shortest path between two services",
    "kb_explain": "An overview of a service: its links, events, modules and counts",
    "kb_field_impact": "Where a field comes from, which messages carry it and who may receive it",
}
_KINDS = {"str": {"type": "string"}, "int": {"type": "integer"}, "bool": {"type": "boolean"}, "list[str]": {"type": "array", "items": {"type": "string"}}}


def input_schema(method) -> dict:
    """A JSON schema of a tool's arguments."""
    given = [p for p in inspect.signature(method).parameters.values() if p.name != "self"]
    kinds = {p.name: _KINDS[str(p.annotation).split(" | ")[0]] for p in given}
    return {"type": "object", "properties": kinds, "required": [p.name for p in given if p.default is inspect.Parameter.empty]}


def tools() -> list[dict]:
    return [{"name": n, "description": PURPOSE[n], "inputSchema": input_schema(getattr(Knowledge, n))} for n in Knowledge.TOOLS]


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def called(kb: Knowledge, params: dict) -> dict:
    """A tool's answer; arguments that do not fit its schema are an error of the call."""
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in Knowledge.TOOLS:
        raise RpcError(BAD_PARAMS, f"Unknown tool: {name}")
    schema = input_schema(getattr(Knowledge, name))
    unknown, missing = sorted(set(given) - set(schema["properties"])), [r for r in schema["required"] if r not in given]
    if unknown or missing:
        raise RpcError(BAD_PARAMS, f"{name}: " + ", ".join([f"unknown argument {u}" for u in unknown] + [f"missing argument {m}" for m in missing]))
    answer = getattr(kb, name)(**given)
    return {"content": [{"type": "text", "text": answer["text"]}], "isError": answer["is_error"]}


def answered(kb: Knowledge, message: Any) -> dict | None:
    """The response to one message, None to a notification."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "not a request"}}
    if "id" not in message:
        return None
    method, params = message["method"], message.get("params") or {}
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": __version__}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": tools()}
        elif method == "tools/call":
            result = called(kb, params)
        else:
            raise RpcError(NO_METHOD, f"Method not found: {method}")
    except RpcError as error:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": error.code, "message": str(error)}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(kb: Knowledge, source: TextIO, sink: TextIO) -> None:
    """Answers messages until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            response = answered(kb, json.loads(line))
        except json.JSONDecodeError as error:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(error)}}
        if response is not None:
            sink.write(json.dumps(response, ensure_ascii=False) + "\n")
            sink.flush()
