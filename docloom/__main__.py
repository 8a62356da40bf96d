"""Command line: python -m docloom STORE COMMAND ..."""

from __future__ import annotations

import argparse

from docloom.engine import Engine
from docloom.session import local_session
from docloom.settings import resolved, store_folder


def main(arguments: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="docloom", description="Ingest and search a store of documents.")
    parser.add_argument("--store", help="folder of the tables; else DOCLOOM_STORE, else a folder of the user")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest", help="add the files below a folder").add_argument("folder")
    commands.add_parser("reingest", help="put the files below a folder in place of their earlier chunks").add_argument("folder")
    pages = commands.add_parser("ingest-pages", help="add web pages from Parquet with page_id, url, html")
    pages.add_argument("path")
    commands.add_parser("migrate", help="bring an older store to the present schema")
    search = commands.add_parser("search", help="search the store")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--mode", default="hybrid")
    search.add_argument("--keywords", action="store_true", help="take the query's intent words alone")
    commands.add_parser("status", help="rows of each table")
    commands.add_parser("jobs", help="run the waiting jobs").add_argument("--limit", type=int, help="how many at most")
    configure = commands.add_parser("configure", help="change settings, as NAME=VALUE")
    configure.add_argument("settings", nargs="+")
    restore = commands.add_parser("restore", help="make an older version of a table the newest")
    restore.add_argument("table")
    restore.add_argument("version", type=int)
    commands.add_parser("vacuum", help="delete old versions of a table").add_argument("table")
    given = parser.parse_args(arguments)
    engine = Engine(spark or local_session("*"), store_folder(given.store), resolved(), migrate=given.command == "migrate")
    if given.command == "ingest":
        engine.ingest(given.folder).show(100, False)
    elif given.command == "reingest":
        print(engine.reingest_files(given.folder).count())
    elif given.command == "ingest-pages":
        print(engine.ingest_pages(engine.spark.read.parquet(given.path).select("page_id", "url", "html")).count())
    elif given.command == "migrate":
        print(", ".join(engine.migrated) or "nothing to do")
    elif given.command == "search":
        engine.search_index(given.query, given.top_k, given.mode, keyword_prefilter=given.keywords).select("place", "score", "match_type", "source_uri", "chunk_index").show(given.top_k, False)
    elif given.command == "status":
        engine.status().show(100, False)
    elif given.command == "jobs":
        print(engine.run_jobs(given.limit))
    elif given.command == "configure":
        print(engine.configure(**dict(s.split("=", 1) for s in given.settings)))
    elif given.command == "restore":
        print(engine.store.restore(given.table, given.version))
    else:
        print(engine.store.vacuum(given.table))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
