"""python -m freshet.cli: looks at ledgers and runs apps. An app is given as module:attribute."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    from freshet.shipping import ship

    return ship(SparkSession.builder.appName("freshet").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def load(spark: SparkSession, name: str):
    """The app of module:attribute; a function there is called with the session."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "app")
    return found(spark) if callable(found) else found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="freshet")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, about in (("show", "rows that the ledger tracks, by target"), ("plan", "numbers of actions that update would apply"), ("diff", "the actions that update would apply"), ("update", "one run"), ("drop", "remove all that the app wrote")):
        p = sub.add_parser(name, help=about)
        p.add_argument("app")
        if name in ("plan", "diff", "update"):
            p.add_argument("--full-reprocess", action="store_true")
    ls = sub.add_parser("ls", help="tables of a ledger folder")
    ls.add_argument("folder")
    lock = sub.add_parser("lock", help="digests of a pipeline's files")
    lock.add_argument("folder")
    pack = sub.add_parser("package", help="a reproducible archive of a pipeline")
    pack.add_argument("folder")
    pack.add_argument("out")
    audit = sub.add_parser("audit-verify", help="whether an audit log is whole")
    audit.add_argument("path")
    sub.add_parser("doctor", help="whether Spark runs here")
    a = parser.parse_args(argv)
    say = lambda x: print(json.dumps(x, sort_keys=True, default=str))
    if a.command in ("lock", "package"):
        from freshet import records

        say(records.lock(a.folder) if a.command == "lock" else records.package(a.folder, a.out))
        return 0
    spark = spark or session()
    if a.command == "audit-verify":
        from freshet.operators.cases import AuditTable

        ok = AuditTable(spark, a.path).verify()
        say({"whole": ok})
        return int(not ok)
    if a.command == "doctor":
        say({"spark": spark.version, "rows": spark.range(3).count()})
        return 0
    if a.command == "ls":
        from freshet.operators.ledger import Ledger

        led = Ledger(spark, a.folder)
        say({"version": led.version, "tables": led.tables()})
        return 0
    app = load(spark, a.app)
    if a.command == "show":
        say({r["target"]: r["rows"] for r in app.stats().collect()})
    elif a.command == "plan":
        say({n: {r["action"]: r["count"] for r in d.groupBy("action").count().collect()} for n, d in app.preview(a.full_reprocess).items()})
    elif a.command == "diff":
        for n, d in app.preview(a.full_reprocess).items():
            for r in d.toLocalIterator():
                say({"target": n} | r.asDict(recursive=True))
    elif a.command == "update":
        say(app.update(a.full_reprocess).counts)
    else:
        app.drop()
        say({"dropped": app.name})
    return 0


if __name__ == "__main__":
    sys.exit(main())
