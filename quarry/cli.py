"""The command line: ``python -m quarry.cli COMMAND``; results are JSON on standard output, errors JSON on standard error."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections import Counter

from quarry.api import Knowledge, ToolError
from quarry.plans.indexing import NO_BRANCH


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    top.add_argument("--store", default=os.environ.get("QUARRY_STORE", os.path.expanduser("~/.quarry")))
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        p = sub.add_parser(name)
        p.add_argument("--timing", action="store_true")
        for a, kw in args:
            p.add_argument(a, **kw)

    flag, one = {"action": "store_true"}, {}
    add("index", ("--root", {"default": os.path.expanduser("~/Documents/Repos")}), ("--repo", {"nargs": "*"}), ("--force", flag), ("--refresh", flag), ("--json", flag), ("--verbose", flag))
    add("search", ("query", {"nargs": "?"}), ("--repo", one), ("--type", one), ("--limit", {"type": int, "default": 20}), ("--entity", flag), ("--list-types", flag))
    add("deps", ("entity", one), ("--direction", {"choices": ["upstream", "downstream"], "default": "upstream"}), ("--mechanism", one), ("--repo", one))
    add("impact", ("service", one), ("--mechanism", one), ("--depth", {"type": int, "default": 3}))
    add("trace", ("start", one), ("end", one))
    add("explain", ("service", one))
    add("field-impact", ("field", one))
    add("learn", ("text", one), ("--repo", one))
    add("learned", ("--repo", one))
    add("forget", ("id", one))
    add("status")
    add("docs")
    add("serve", ("--root", one))
    return top


def reference() -> str:
    """All commands with their arguments, as Markdown."""
    top = parser()
    commands = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction)).choices
    lines = ["# quarry", "", "Results are JSON on standard output; errors are JSON on standard error, with exit code 1.", ""]
    for name, sub in commands.items():
        lines += [f"## {name}", ""]
        for a in sub._actions:
            if "-h" not in a.option_strings:
                lines.append(f"- `{', '.join(a.option_strings) or a.dest}`" + (f" (default `{a.default}`)" if a.default not in (None, False) else ""))
        lines.append("")
    return "\n".join(lines)


class CommandError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def run(args: argparse.Namespace, kb: Knowledge):
    c = args.command
    try:
        if c == "index":
            shown = (lambda done, total, name: print(f"[{done}/{total}] {name}", file=sys.stderr)) if args.verbose else None
            return kb.index(args.root, names=args.repo, force=args.force, refresh=args.refresh, progress=shown)
        if c == "search":
            if args.list_types:
                return kb.types()
            if not args.query:
                raise CommandError("MISSING_QUERY", "a query is needed")
            return kb.entity(args.query, args.type, None, args.repo) if args.entity else kb.search(args.query, args.limit, args.repo, args.type)
        if c == "deps":
            return kb.deps(args.entity, args.direction, 1, args.repo, args.mechanism)
        if c == "impact":
            return kb.impact(args.service, args.mechanism, args.depth)
        if c == "trace":
            return kb.trace(args.start, args.end)
        if c == "explain":
            return kb.explain(args.service)
        if c == "field-impact":
            return kb.field_impact(args.field)
        if c == "learn":
            return kb.learn(args.text, args.repo)
        if c == "learned":
            return kb.learned(args.repo)
        if c == "forget":
            if not args.id.lstrip("-").isdigit():
                raise CommandError("INVALID_ID", f"not an id: {args.id}")
            if not kb.forget(int(args.id)):
                raise CommandError("NOT_FOUND", f"no fact {args.id}")
            return {"deleted": True}
        return kb.status() if c == "status" else reference()
    except ToolError as error:
        codes = {"trace": "TRACE_ERROR", "explain": "EXPLAIN_ERROR"}
        raise CommandError("INVALID_MECHANISM" if "mechanism" in str(error) else codes.get(c, "ERROR"), str(error)) from error


def index_summary(results: list[dict]) -> str:
    """An index run in a few lines: the counts, errors by category, and what was skipped for want of a branch, failed, is missing or could not be refreshed."""
    by = lambda s: sum(r["status"] == s for r in results)
    lines = [f"{by('success')} indexed, {by('skipped')} skipped, {by('error')} failed"]
    lines += [f"{r['repo']}: {r['reason']}" for r in results if r.get("reason") == NO_BRANCH]
    kinds = Counter(r["category"] for r in results if r.get("category"))
    lines += [f"{kind}: {n}" for kind, n in sorted(kinds.items(), key=lambda k: (-k[1], k[0]))] if len(kinds) > 1 or kinds.total() > 1 else []
    lines += [f"{r['repo']}: {r['error']} ({r['category']})" for r in results if r["status"] == "error"]
    lines += [f"{r['repo']}: {r['reason']}" for r in results if r["status"] == "missing"]
    lines += [f"{r['repo']}: not refreshed, {r['refresh_error']}" for r in results if r.get("refresh_error")]
    return "\n".join(lines)


def main(argv: list[str] | None = None, kb: Knowledge | None = None) -> int:
    args = parser().parse_args(argv)
    began = time.time()
    if kb is None:
        from quarry.plans.store import Store
        from quarry.session import local_session

        kb = Knowledge(Store(local_session("*"), args.store), getattr(args, "root", None) if args.command == "serve" else None)
    if args.command == "serve":
        from quarry.server import serve

        serve(kb, sys.stdin, sys.stdout)
        return 0
    try:
        got = run(args, kb)
    except CommandError as error:
        print(json.dumps({"error": str(error), "code": error.code}), file=sys.stderr)
        return 1
    if isinstance(got, str):
        print(got)
    elif args.command == "index" and not args.json and sys.stdout.isatty():
        print(index_summary(got))
    else:
        print(json.dumps(got, indent=2, ensure_ascii=False, default=str))
    if args.timing:
        print(json.dumps({"seconds": round(time.time() - began, 3)}), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
