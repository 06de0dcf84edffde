"""Command line: ``python -m tagloom --store FOLDER index|search|tag|untag|note|type|clear ...``"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None, spark=None) -> int:
    from .operators import edit as E

    p = argparse.ArgumentParser(prog="tagloom")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("index", help="scan folders")
    s.add_argument("roots", nargs="+")
    s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("search", help="run a query")
    s.add_argument("query")
    s.add_argument("-n", type=int, default=100)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--mode", choices=("table", "groups", "short"), default="table")
    s.add_argument("--format", choices=("human", "iso", "relative", "raw"), default="human", help="how sizes and dates are shown")
    s.add_argument("--order", action="append", default=[], help="a type; -type for falling order")
    for name in ("tag", "untag"):
        s = sub.add_parser(name, help=f"{name} a query's items")
        s.add_argument("query")
        s.add_argument("edit")
        if name == "tag":
            s.add_argument("--on-conflict", choices=E.CONFLICT, default="abort", help="several targets of a file, or several files with one")
            s.add_argument("--on-hardlink", choices=E.HARDLINK, default="abort")
            s.add_argument("--dry-run", action="store_true", help="show which files would move")
    s = sub.add_parser("note", help="store a note")
    s.add_argument("name")
    s.add_argument("content", nargs="?")
    s = sub.add_parser("type", help="set the kind of a user type")
    s.add_argument("name")
    s.add_argument("kind")
    sub.add_parser("list", help="list types")
    sub.add_parser("clear", help="drop stored results")
    a = p.parse_args(args)

    from .plans.syntax import QueryError
    from .store import Store

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tagloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    try:
        if a.command == "index":
            print(" ".join(f"{k}:{v}" for k, v in store.index(a.roots, a.dry_run).items()))
        elif a.command in ("search", "list"):
            text, n, offset, order = (a.query, a.n, a.offset, tuple((o.lstrip("-"), o.startswith("-")) for o in a.order)) if a.command == "search" else ("type:*", 0, 0, ())
            found = store.search(text, n + 1 if n else 0, offset, order)
            rows, columns = found.df.collect(), found.df.columns
            print(store.shown(found, rows[:n] if n else rows, columns, getattr(a, "mode", "table"), getattr(a, "format", "human")))
            for w in found.warnings:
                print(f"warning: {w}", file=sys.stderr)
            if n and len(rows) > n:
                print("there is more")
        elif a.command == "note":
            print(store.note(a.name, a.content))
        elif a.command == "type":
            store.set_type(a.name, a.kind)
        elif a.command == "clear":
            store.cache.clear()
        elif a.command == "tag":
            moves = store.tag(a.query, a.edit, a.on_conflict, a.on_hardlink, a.dry_run)
            print("\n".join(f"{r['path']} -> {r['target']}" for r in moves))
        else:
            getattr(store, a.command)(a.query, a.edit)
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
