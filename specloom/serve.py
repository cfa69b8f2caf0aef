"""The catalogue over HTTP for agents, as JSON-RPC 2.0 in the Model Context Protocol: resources to read and tools to call."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from typing import Any

from specloom.api import Catalog, dumps

PROTOCOL = "2025-03-26"
_VERSION = ("version", "Version of the specification, such as 2.4.", True)

#: Tools: what they are for, and their arguments (name, meaning, whether it must be there).
TOOLS: dict[str, tuple[str, tuple[tuple[str, str, bool], ...]]] = {
    "query_entity": ("One entity of a version with its properties and relationships.", (_VERSION, ("name", "The entity's name.", True))),
    "query_validation_rules": ("Validation rules of a version, of one phase or of all.", (_VERSION, ("phase", "A phase of validation.", False))),
    "diff_versions": ("Entities and rules that two versions differ in.", (("from_version", "The earlier version.", True), ("to_version", "The later version.", True))),
    "search_entities": ("Entities with a text in their name or description, in any case.", (_VERSION, ("query", "The text to look for.", True))),
}
#: Resources by address.
RESOURCES = {
    "spec://versions": ("versions", "All known versions with their dates."), "spec://{version}/entities": ("entities", "Names of a version's entities."),
    "spec://{version}/entity/{name}": ("entity", "One entity of a version."),
}


class Service:
    """Answers requests from a catalogue; a Spark session is one, so requests take turns."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self._turn = catalog, Lock()

    def call(self, name: str, a: dict[str, Any]) -> Any:
        missing = [x for x, _, must in TOOLS[name][1] if must and x not in a]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        c = self.catalog
        made: dict[str, Callable[[], Any]] = {
            "query_entity": lambda: c.query_entity(a["version"], a["name"]), "query_validation_rules": lambda: c.query_rules(a["version"], a.get("phase") or None),
            "diff_versions": lambda: c.diff_versions(a["from_version"], a["to_version"]), "search_entities": lambda: c.search(a["version"], a["query"]),
        }
        return made[name]()

    def read(self, uri: str) -> Any:
        if uri == "spec://versions":
            return self.catalog.versions()
        if m := re.fullmatch(r"spec://([^/]+)/entities", uri):
            return self.catalog.entities(m[1])
        if m := re.fullmatch(r"spec://([^/]+)/entity/(.+)", uri):
            return self.catalog.entity(m[1], m[2])
        raise KeyError(f"no resource {uri!r}")

    def answer(self, request: dict[str, Any]) -> dict[str, Any] | None:
        """The response to a request; None for a notification, which has no id."""
        if "id" not in request:
            return None
        head = {"jsonrpc": "2.0", "id": request["id"]}
        method, p = request.get("method"), request.get("params") or {}
        try:
            with self._turn:
                if method == "initialize":
                    result: Any = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "specloom", "version": "1"}}
                elif method == "ping":
                    result = {}
                elif method == "tools/list":
                    result = {"tools": [
                        {"name": n, "description": about, "inputSchema": {"type": "object", "properties": {x: {"type": "string", "description": said} for x, said, _ in args}, "required": [x for x, _, must in args if must]}}
                        for n, (about, args) in TOOLS.items()]}
                elif method == "tools/call" and p.get("name") in TOOLS:
                    try:
                        result = {"content": [{"type": "text", "text": dumps(self.call(p["name"], p.get("arguments") or {}))}], "isError": False}
                    except (KeyError, ValueError, FileNotFoundError) as e:
                        result = {"content": [{"type": "text", "text": str(e.args[0] if e.args else e)}], "isError": True}
                elif method == "resources/list":
                    result = {"resources": [{"uri": u, "name": n, "description": d, "mimeType": "application/json"} for u, (n, d) in RESOURCES.items() if "{" not in u]}
                elif method == "resources/templates/list":
                    result = {"resourceTemplates": [{"uriTemplate": u, "name": n, "description": d, "mimeType": "application/json"} for u, (n, d) in RESOURCES.items() if "{" in u]}
                elif method == "resources/read":
                    result = {"contents": [{"uri": p.get("uri", ""), "mimeType": "application/json", "text": dumps(self.read(p.get("uri", "")))}]}
                else:
                    return head | {"error": {"code": -32601, "message": f"unknown method or tool: {p.get('name', method)}"}}
        except (KeyError, FileNotFoundError) as e:
            return head | {"error": {"code": -32602, "message": str(e.args[0] if e.args else e)}}
        return head | {"result": result}


def server(catalog: Catalog, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of one address, ``/mcp``, that isn't running yet; port 0 takes a free one."""
    service = Service(catalog)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, document: Any = None) -> None:
            body = b"" if document is None else json.dumps(document).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            if self.path.rstrip("/") != "/mcp":
                return self._send(404)
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                many = asked if isinstance(asked, list) else [asked]
                answers = [a for a in map(service.answer, many) if a is not None]
            except (ValueError, AttributeError, TypeError):
                return self._send(400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON-RPC request"}})
            return self._send(202) if not answers else self._send(200, answers if isinstance(asked, list) else answers[0])

        def do_GET(self) -> None:
            self._send(405)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
