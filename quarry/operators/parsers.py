"""Parsers of brace and do-end languages: plain functions from a file's content to rows.

They serve the table functions of ``extract``, which run them once per file inside
Arrow batches. What one pattern can state is not here but a column expression.
"""

from __future__ import annotations

import re

from quarry.operators import fixed_values as V

_A = re.ASCII


def closing_braces(text: str) -> dict[int, int]:
    """Each opening brace's position with that of the brace that closes it; unclosed ones are absent."""
    open_, pairs = [], {}
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            pairs[open_.pop()] = m.start()
    return pairs


def _blocks(head: re.Pattern, text: str):
    """Matches of a head that ends in an opening brace, each with the body up to the closing one; unclosed ones are dropped."""
    closed = closing_braces(text)
    for m in head.finditer(text):
        end = closed.get(m.end() - 1)
        if end is not None:
            yield m, text[m.end() : end]


# --- protocol buffers -------------------------------------------------------------------------------------------

_MESSAGE, _SERVICE = re.compile(V.PROTO_MESSAGE, re.M | _A), re.compile(V.PROTO_SERVICE, re.M | _A)
_PROTO_FIELD = re.compile(V.PROTO_FIELD, re.M | _A)
_RPC = re.compile(V.PROTO_RPC, _A)


def proto_messages(text: str) -> list[dict]:
    """Messages that begin at the start of a line: name and fields (name, type, optional); inner messages' fields count as the outer's."""
    return [
        {"name": m.group(1), "fields": [{"name": f.group(3), "type": f.group(2), "optional": f.group(1) == "optional"} for f in _PROTO_FIELD.finditer(body) if f.group(2) not in V.PROTO_NO_TYPES]}
        for m, body in _blocks(_MESSAGE, text)
    ]


def proto_services(text: str) -> list[dict]:
    """Services that begin at the start of a line: name and unary calls (name, input, output)."""
    return [{"name": m.group(1), "rpcs": [dict(zip(("name", "input", "output"), r.groups())) for r in _RPC.finditer(body)]} for m, body in _blocks(_SERVICE, text)]


def proto_package(text: str) -> str | None:
    m = re.search(V.PROTO_PACKAGE, text, re.M | _A)
    return m.group(1) if m else None


# --- GraphQL ----------------------------------------------------------------------------------------------------

_DEFINITION = re.compile(V.GRAPHQL_DEFINITION, re.M | _A)
_UNION, _SCALAR = re.compile(V.GRAPHQL_UNION, re.M | _A), re.compile(V.GRAPHQL_SCALAR, re.M | _A)
_GRAPHQL_FIELD = re.compile(V.GRAPHQL_FIELD, re.M | _A)
#: Kinds of definitions whose bodies declare fields.
FIELD_KINDS = V.GRAPHQL_FIELD_KINDS


def graphql_types(text: str) -> list[dict]:
    """Definitions: kind, name, body and whether they extend one."""
    rows = [{"kind": m.group(2), "name": m.group(3), "body": body.strip(), "extended": bool(m.group(1))} for m, body in _blocks(_DEFINITION, text)]
    rows += [{"kind": "union", "name": m.group(2), "body": m.group(3).strip(), "extended": bool(m.group(1))} for m in _UNION.finditer(text)]
    return rows + [{"kind": "scalar", "name": m.group(1), "body": "", "extended": False} for m in _SCALAR.finditer(text)]


def graphql_fields(body: str) -> list[dict]:
    """Fields of a body: name, type as written, and whether it may be null."""
    return [{"name": m.group(1), "type": m.group(2), "nullable": not m.group(2).endswith("!")} for m in _GRAPHQL_FIELD.finditer(body)]


# --- Elixir -----------------------------------------------------------------------------------------------------

_MODULE, _DOC_FALSE, _TABLE, _SCHEMA, _FIELD, _ASSOC, _NAMED_MACRO, _ROOT_MACRO, _CLIENT_STUB, _STUB_CALL, _SIGIL, _LIST, _REQUIRED, _CAST, _ATOM, _ATTRIBUTE = (
    re.compile(p, _A)
    for p in (
        V.MODULE, V.DOC_FALSE, V.TABLE, V.SCHEMA, V.ECTO_FIELD, V.ASSOCIATION, V.NAMED_MACRO, V.ROOT_MACRO, V.CLIENT_STUB, V.STUB_CALL, V.WORD_ATTRIBUTE, V.LIST_ATTRIBUTE, V.REQUIRED_CALL, V.CAST_CALL, V.ATOM, V.ATTRIBUTE,
    )
)
_DOCS = (re.compile(V.DOC_BLOCK), re.compile(V.DOC_LINE))
_DEF, _BARE_DEF = re.compile(V.DEFINITION, re.M | _A), re.compile(V.BARE_DEFINITION, re.M | _A)


def _distinct(items) -> list:
    return list(dict.fromkeys(items))


def module_doc(body: str) -> str | None:
    if _DOC_FALSE.search(body):
        return None
    found = next((m for m in (p.search(body) for p in _DOCS) if m), None)
    return (found.group(1).strip() or None) if found else None


def public_functions(body: str) -> list[str]:
    """name/arity of public definitions, sorted; a bare one counts only where none with parentheses has its name."""
    found = {(m.group(1), len(m.group(2).split(",")) if m.group(2).strip() else 0) for m in _DEF.finditer(body)}
    known = {name for name, _ in found}
    found |= {(m.group(1), 0) for m in _BARE_DEF.finditer(body) if m.group(1) not in known}
    return sorted(f"{name}/{arity}" for name, arity in found)


def schema_block(body: str) -> list[str]:
    """The stripped lines of the table schema up to the end that closes it; none for an embedded schema."""
    start = _SCHEMA.search(body)
    lines, depth = [], 1
    for line in body[start.end() :].split("\n") if start else []:
        line = line.strip()
        depth += bool(re.search(r"\bdo\b", line, _A)) - bool(re.match(r"end\b", line, _A))
        if depth <= 0:
            break
        lines.append(line)
    return lines


def attribute_lists(body: str) -> dict[str, list[str]]:
    """Names that module attributes list, as words or as atoms; words come first."""
    found = {m.group(1): m.group(2).split() for m in _SIGIL.finditer(body) if m.group(1) not in V.PLAIN_ATTRIBUTES}
    words = {k for k, v in found.items()}
    for m in _LIST.finditer(body):
        if m.group(1) not in V.PLAIN_ATTRIBUTES and m.group(1) not in words and m.group(1) not in found:
            found[m.group(1)] = _ATOM.findall(m.group(2))
    return found


def listed_fields(pattern: re.Pattern, body: str, attributes: dict[str, list[str]]) -> list[str]:
    """Fields that calls list: atoms in place first, then those of attributes."""
    calls = list(pattern.finditer(body))
    inline = [a for m in calls if m.group(1) is not None for a in _ATOM.findall(m.group(1))]
    named = [f for m in calls if m.group(1) is None for a in _ATTRIBUTE.findall(m.group(2) if m.group(2).startswith("@") else "@" + m.group(2)) for f in attributes.get(a, [])]
    return _distinct(inline + named)


def module_type(name: str, table: str | None) -> str:
    """schema for a module with a table; else by its name; else module."""
    if table:
        return "schema"
    return next((kind for kind, rule in V.MODULE_KINDS if re.search(rule, name)), "module")


def elixir_modules(text: str) -> list[dict]:
    """Modules of a file; a module's body ends where the next one begins, inner modules included."""
    heads = list(_MODULE.finditer(text))
    rows = []
    for head, after in zip(heads, [*heads[1:], None]):
        body = text[head.start() : after.start() if after else len(text)]
        table = _TABLE.search(body)
        table = table.group(1) if table else None
        fields, assocs = [], []
        for line in schema_block(body):
            if m := _FIELD.search(line):
                fields.append({"name": m.group(1), "type": m.group(2)})
            elif m := _ASSOC.search(line):
                assocs.append({"kind": m.group(1), "name": m.group(2), "target": m.group(3)})
        attributes = attribute_lists(body)
        required, cast = listed_fields(_REQUIRED, body, attributes), listed_fields(_CAST, body, attributes)
        rows.append(
            {
                "name": head.group(1),
                "type": module_type(head.group(1), table),
                "moduledoc": module_doc(body),
                "functions": public_functions(body),
                "table_name": table,
                "schema_fields": fields,
                "associations": assocs,
                "absinthe_types": [{"kind": m.group(1), "name": m.group(2)} for m in _NAMED_MACRO.finditer(body)] + [{"kind": m.group(1), "name": m.group(1)} for m in _ROOT_MACRO.finditer(body)],
                "grpc_stubs": _distinct([m.group(1) for m in _CLIENT_STUB.finditer(body)] + [f"{m.group(1)}.Stub" for m in _STUB_CALL.finditer(body)]),
                "required_fields": required,
                "optional_fields": [f for f in cast if f not in required],
                "cast_fields": cast,
            }
        )
    return rows


# --- Markdown and front matter ------------------------------------------------------------------------------------


def first_paragraph(text: str) -> str | None:
    """The first paragraph after the title, or the first at all where there is no title; badges, images and HTML are skipped."""
    lines = [line.strip() for line in text.split("\n")]
    titled = any(line.startswith("# ") for line in lines)
    begun, kept = False, []
    for line in lines:
        if not line:
            if begun and kept:
                break
        elif line.startswith("# ") and not begun:
            begun = True
        elif line.startswith("##"):
            break
        elif not line.startswith(("![", "[![", "<", "---")) and (begun or not titled):
            kept.append(line)
    return " ".join(kept).strip() or None


def front_matter(text: str) -> dict[str, str | list[str]]:
    """Flat keys of the block between the first two lines of dashes: a text without its quotes, or a list."""
    block = re.match(r"---\n([\s\S]*?)\n---", text)
    out: dict[str, str | list[str]] = {}
    key = None
    bare = lambda s: re.sub(r"^['\"]|['\"]$", "", s)
    for line in block.group(1).split("\n") if block else []:
        if m := re.match(r"(\w[\w-]*):\s*(.*)$", line, _A):
            key, value = m.group(1), m.group(2).strip()
            out[key] = bare(value) if value and value != ">-" else []
        elif key is not None and (m := re.match(r"\s+-\s+(.+)", line)):
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(bare(m.group(1).strip()))
    return out


def listed_id(item: str) -> str:
    """The id that a list item of front matter states, or the item itself."""
    m = re.search(r"id:\s*'?([^'\"\s]+)'?", item)
    return m.group(1) if m else item
