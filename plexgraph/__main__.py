"""Command line: ``analyze REPO STORE`` writes a graph, the other commands answer from it."""

from __future__ import annotations

import argparse
from pathlib import Path

from plexgraph.plans.analyze import analyze
from plexgraph.plans.tools import Tools
from plexgraph.session import session
from plexgraph.sources import files, store

ONE = ("query", "context", "explain", "impact", "export", "file_context", "coupled", "sql")
NONE = ("overview", "dead_code", "cycles", "communities", "cross_community")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plexgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("repo")
    a.add_argument("store")
    for name in (*ONE, *NONE, "call_path"):
        c = sub.add_parser(name)
        c.add_argument("store")
        for k in range(2 if name == "call_path" else name in ONE):
            c.add_argument(f"a{k}")
    args = p.parse_args(argv)
    spark = session("local[*]", 8, "4g", **{"spark.ui.showConsoleProgress": "false"})
    root = args.store if "://" in args.store else Path(args.store).resolve().as_uri()
    if args.command == "analyze":
        before = store.load(spark, root, "parsed")
        g = analyze(files.from_repo(spark, args.repo), files.git_log(spark, args.repo), before=before)
        store.save(root, {"nodes": g.nodes, "edges": g.edges, "unresolved": g.unresolved, "parsed": g.parsed})
        store.write_meta(spark, f"{root}/registry", Path(args.repo).resolve().name, args.repo, g.nodes, g.edges)
        return
    nodes = store.load(spark, root, "nodes")
    if nodes is None:
        p.error(f"{args.store} holds no graph; run analyze first")
    tools = Tools(nodes, store.load(spark, root, "edges"))
    given = [v for k, v in sorted(vars(args).items()) if k in ("a0", "a1")]
    getattr(tools, args.command)(*given).show(100, False)


if __name__ == "__main__":
    main()
