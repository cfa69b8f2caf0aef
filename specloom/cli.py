"""Command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from specloom import api
from specloom.sources import registry


def _session():
    from specloom.session import local_session

    return local_session()


def generate(source: str, versions: list[str], out: str, checkout: bool = True) -> list[str]:
    """Documents of some versions, newest first; versions that fail are reported and returned. The pointer names the newest that is there."""
    from specloom.graph import build_trees
    from specloom.sinks import documents

    failed, done = [], []
    for v in versions:
        try:
            if checkout:
                registry.checkout(source, v)
            graph = build_trees(_session(), {v: source})
            for path in documents.write_all(graph, v, out):
                print(f"  Wrote {path}")
            done.append(v)
        except Exception as e:  # another version may still work
            print(f"ERROR: version {v} failed: {e}", file=sys.stderr)
            failed.append(v)
    if done:
        documents.write_pointer(done[0], out)
    return failed


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="specloom", description="Specification graphs on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("generate", help="documents of one version")
    one.add_argument("--version", required=True)
    every = sub.add_parser("generate-all", help="documents of all versions")
    for s in (one, every):
        s.add_argument("--spec-source", required=True)
        s.add_argument("--output-dir", required=True)
        s.add_argument("--no-checkout", action="store_true", help="take the tree as it is")
    ask = sub.add_parser("query", help="an entity, rules of a phase, or a search, as JSON")
    ask.add_argument("--output-dir", required=True)
    ask.add_argument("--version", required=True)
    what = ask.add_mutually_exclusive_group(required=True)
    what.add_argument("--entity")
    what.add_argument("--phase", nargs="?", const="")
    what.add_argument("--search")
    d = sub.add_parser("diff", help="changes between two versions")
    d.add_argument("--output-dir", required=True)
    d.add_argument("--from", dest="old", required=True)
    d.add_argument("--to", dest="new", required=True)
    web = sub.add_parser("serve", help="the catalogue over HTTP, for agents")
    web.add_argument("--output-dir", required=True)
    web.add_argument("--port", type=int, default=8000)
    sub.add_parser("list-versions", help="known versions and their dates")
    a = p.parse_args(argv)
    if a.command == "list-versions":
        versions = registry.list_versions()
        width = max(len(v.version) for v in versions) + 2
        print(f"{'Version':<{width}}Date\n{'-' * (width + 12)}")
        print("\n".join(f"{v.version:<{width}}{v.date}" for v in versions))
        return 0
    if a.command in ("generate", "generate-all"):
        if a.command == "generate":
            try:
                registry.get_version(a.version)
            except KeyError as e:
                p.error(e.args[0])
        if not Path(a.spec_source).is_dir():
            p.error(f"no folder {a.spec_source}")
        versions = [a.version] if a.command == "generate" else [v.version for v in registry.list_versions()]
        return int(bool(generate(a.spec_source, versions, a.output_dir, not a.no_checkout)))
    catalog = api.Catalog(_session(), a.output_dir)
    if a.command == "serve":
        from specloom.serve import server

        with server(catalog, a.port) as web:
            print(f"Serving {a.output_dir} at http://127.0.0.1:{web.server_port}/mcp")
            web.serve_forever()
        return 0
    try:
        if a.command == "diff":
            document = catalog.diff(a.old, a.new)
        elif a.entity:
            document = catalog.query_entity(a.version, a.entity)
        elif a.search:
            document = catalog.search(a.version, a.search)
        else:
            document = catalog.query_rules(a.version, a.phase or None)
    except FileNotFoundError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    print(api.dumps(document))
    return 0


if __name__ == "__main__":
    sys.exit(main())
