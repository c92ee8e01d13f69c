"""Tools over JSON-RPC 2.0, one object a line: ``initialize``, ``tools/list`` and ``tools/call``.

Arguments are strict: unknown ones are errors. Writers apply their changes to the folder and to the workspace at hand.
"""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame

from .operators import edits
from .operators.export import json_rows
from .plans.parse import QueryError
from .sources import files
from .workspace import Workspace

READERS = ("find", "retrieve", "tree", "stats", "squash")
WRITERS = ("create", "update", "delete", "rename", "extract", "inline", "normalize", "attach")
PROTOCOL = "2024-11-05"


def _delete(w: Workspace, keys: list[str]) -> DataFrame:
    return w.delete(*keys)


def _find(w: Workspace, project: str | None = None, add_fields: str | None = None, lexical: str | None = None, fuzzy: str | None = None, sort: str | None = None, limit: int = 0, blocks: str | None = None, matches: str | None = None, filter: str | None = None, key: list[str] = (), roots: bool = False, includes: list = (), included_by: list = (), references: list = (), referenced_by: list = ()) -> DataFrame:
    return w.find(project, add_fields, lexical, fuzzy, sort, limit, blocks, matches, filter=filter, key=key, roots=roots, includes=includes, included_by=included_by, references=references, referenced_by=referenced_by, max_depth=None, max_distance=None)


def _inline(w: Workspace, key: str, reference: str | int, as_quote: bool = False, keep: bool = False) -> DataFrame:
    return w.inline(key, reference, as_quote=as_quote, keep=keep)


def _retrieve(w: Workspace, keys: list[str] = (), expand: dict[str, int] | None = None, lexical: str | None = None, fuzzy: str | None = None, limit: int = 0) -> DataFrame:
    return w.retrieve(keys, expand, lexical, fuzzy, limit)


_OWN = {"delete": _delete, "find": _find, "inline": _inline, "retrieve": _retrieve}
TOOLS = {name: _OWN.get(name) or getattr(Workspace, name) for name in (*READERS, "query", *WRITERS)}
_TYPES = {"str": "string", "int": "integer", "bool": "boolean", "list": "array", "dict": "object"}


def description(name: str) -> dict:
    """A tool as listed: its arguments as a closed object."""
    tool = TOOLS[name]
    given = list(inspect.signature(tool).parameters.values())[1:]
    kind = lambda p: sorted({_TYPES[t.strip().split("[")[0]] for t in str(p.annotation).split("|") if t.strip() != "None"})
    properties = {p.name: {"type": k[0] if len(k := kind(p)) == 1 else k} for p in given}
    required = [p.name for p in given if p.default is p.empty]
    return {"name": name, "description": (getattr(Workspace, name).__doc__ or name).strip(), "inputSchema": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}}


class Server:
    def __init__(self, workspace: Workspace, folder: str | None = None):
        self.workspace, self.folder = workspace, folder

    def call(self, name: str, arguments: dict):
        if name not in TOOLS:
            raise KeyError(f"no tool {name!r}")
        if unknown := set(arguments) - set(description(name)["inputSchema"]["properties"]):
            raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")
        result = TOOLS[name](self.workspace, **arguments)
        if name in WRITERS or name == "query" and arguments.get("kind") in ("update", "delete"):
            changed = [r.asDict() for r in result.select("op", "key").orderBy("key").limit(edits.LISTED).collect()]
            after = self.workspace.commit(result)
            if self.folder:
                files.apply_to_directory(result, self.folder)
            self.workspace = after
            return changed
        if isinstance(result, DataFrame):
            return [json.loads(r["value"]) for r in json_rows(result).toLocalIterator()]
        return result

    def answer(self, request: dict) -> dict | None:
        """The reply to a request; None for a notification."""
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quillon", "version": "1"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": [description(name) for name in TOOLS]}}
        if method != "tools/call":
            return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}
        try:
            found = self.call(params.get("name", ""), params.get("arguments") or {})
            said, failed = found if isinstance(found, str) else json.dumps(found, default=str), False
        except (ValueError, KeyError, TypeError, QueryError, edits.EvaluationError) as e:
            said, failed = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": said}], "isError": failed}}


def serve(workspace: Workspace, folder: str | None, lines, out) -> None:
    server = Server(workspace, folder)
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = server.answer(json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)
