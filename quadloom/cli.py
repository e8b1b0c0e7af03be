"""python -m quadloom.cli server | cli | create-db | create-index"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .engine import Engine
from .server import serve
from .sources import dumps, quads
from .terms import SparqlError


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quadloom")
    p.add_argument("-d", "--database", default="quads", help="folder of the quad table")
    sub = p.add_subparsers(dest="command", required=True)
    server = sub.add_parser("server")
    server.add_argument("-p", "--port", type=int, default=8005)
    for reader in (server, sub.add_parser("cli")):
        reader.add_argument("--by-object", default=None, help="folder of the copy clustered by object, for lookups by object")
    create = sub.add_parser("create-db")
    create.add_argument("-f", "--file", required=True, help="dump file or folder")
    create.add_argument("-n", "--no-qualifiers", action="store_true")
    create.add_argument("-l", "--languages", nargs="*", default=None, help="of labels; all if not given, none if empty")
    create.add_argument("--by-object", default=None, help="folder for a second copy clustered by object")
    index = sub.add_parser("create-index")
    index.add_argument("--by-object", required=True)
    return p.parse_args(args)


def open_engine(spark: SparkSession, database: str, by_object: str | None = None) -> Engine:
    return Engine(quads.QuadSource(quads.read(spark, database), quads.read(spark, by_object) if by_object else None))


def repl(engine: Engine, lines: Iterable[str]) -> None:
    """Reads queries that end with a blank line, until exit."""
    held: list[str] = []
    for line in lines:
        if line.strip() == "exit":
            return
        if line.strip():
            held.append(line)
            continue
        if held:
            try:
                engine.sparql("\n".join(held)).show(12, truncate=False)
            except SparqlError as e:
                print(f"error: {e}")
            held = []


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "create-db":
        quads.write(dumps.read(spark, a.file, a.languages, not a.no_qualifiers), a.database, a.by_object)
    elif a.command == "create-index":
        table = quads.read(spark, a.database)
        quads.write_by_object(table, a.by_object)
    else:
        engine = open_engine(spark, a.database, a.by_object)
        if a.command == "server":
            serve(engine, a.port).serve_forever()
        else:
            repl(engine, sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
