"""Commands: ingest a folder into an index, ask it, inspect it, check settings and the installation.

    python -m corpusloom index SOURCE INDEX [--chunker recursive]
    python -m corpusloom ask INDEX QUESTION [--preset simple]
    python -m corpusloom inspect INDEX
    python -m corpusloom validate CONFIG
    python -m corpusloom doctor
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def index(source: str, to: str, chunker: str = "recursive") -> int:
    from pyspark.sql import functions as F

    from .plans.build import chunker as named
    from .plans.build import ingest
    from .sources import files, records
    from .sources import index as store

    spark = session()
    with records.writer_lock(to):
        store.save_index(ingest(spark, source, named(chunker)), to)
        read = files.scan(spark, source)
        records.save_manifest(read.select(F.col("source").alias("path"), F.sha2("content", 256).alias("sha256"), "size_bytes", F.unix_timestamp("mtime").cast("double").alias("mtime")), f"{to}/manifest")
    print(json.dumps(inspect(to, False)))
    return 0


def inspect(at: str, show: bool = True) -> dict:
    from .sources import index as store
    from .sources import records

    spark = session()
    row = store.inspect(store.load_index(spark, at), records.load_manifest(spark, f"{at}/manifest")).first().asDict()
    if show:
        print(json.dumps(row))
    return row


def ask(at: str, question: str, preset: str = "simple") -> int:
    from .plans.engine import preset as named
    from .plans.build import Engine
    from .sources.index import load_index

    spark = session()
    answer = Engine(load_index(spark, at), named(preset)).ask(spark.createDataFrame([(1, question)], "query_id bigint, query string")).first()
    print(answer.answer)
    for s in answer.source_ids:
        print(f"- {s}")
    return 0


def doctor() -> int:
    """0 if what is needed is installed; optional packages are only named."""
    needed, optional = ("pyspark", "pyarrow", "pandas", "numpy"), ("pypdf", "yaml", "xxhash")
    there = {n: importlib.util.find_spec(n) is not None for n in (*needed, *optional)}
    print(json.dumps(there))
    return 0 if all(there[n] for n in needed) else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("source")
    a.add_argument("index")
    a.add_argument("--chunker", default="recursive")
    a = sub.add_parser("ask")
    a.add_argument("index")
    a.add_argument("question")
    a.add_argument("--preset", default="simple")
    a = sub.add_parser("inspect")
    a.add_argument("index")
    a = sub.add_parser("validate")
    a.add_argument("config")
    sub.add_parser("doctor")
    args = p.parse_args(argv)
    if args.command == "index":
        return index(args.source, args.index, args.chunker)
    if args.command == "ask":
        return ask(args.index, args.question, args.preset)
    if args.command == "inspect":
        inspect(args.index)
        return 0
    if args.command == "validate":
        from .sources.tables import load_config

        try:
            load_config(args.config)
        except ValueError as e:
            print(f"invalid: {e}", file=sys.stderr)
            return 1
        print("valid")
        return 0
    return doctor()


if __name__ == "__main__":
    sys.exit(main())
