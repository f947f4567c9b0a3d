"""Command line: ``python -m lodestone.plans.cli index|blocks|merge|search|stats``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from lodestone.operators import index
from lodestone.plans import search, snippets
from lodestone.sources import collection as src


def _print_hits(engine: search.SearchEngine, spark: SparkSession, query: str, mode: str, k: int, source: str | None) -> None:
    began = time.time()
    hits = engine.search(query, mode, k)
    if source:
        hits = snippets.with_snippets(search.with_text(hits, src.read_tsv(spark, source)), query)
    rows = hits.orderBy("rank").collect()
    for r in rows:
        print(f"{r['rank']}. [Doc {r['doc_id']}] [Score: {r['score']:.4f}] {r['snippet'] if source else r['passage_id']}")
    print("No Results" if not rows else f"{len(rows)} of {engine.total_hits(query, mode)} results in {time.time() - began:.2f} s")


def _interactive(engine: search.SearchEngine, spark: SparkSession, lines, mode: str, k: int, source: str | None) -> None:
    """Queries, one a line, until an empty one; a line ``/k N`` or ``/mode NAME`` holds for the queries after it."""
    for line in lines:
        line = line.strip()
        if line in ("", "exit", "quit"):
            return
        word, _, value = line.partition(" ")
        if word == "/k" and value.strip().isdigit() and int(value) > 0:
            k = int(value)
        elif word == "/mode" and value.strip() in search.MODES:
            mode = value.strip()
        elif line.startswith("/"):
            print(f"unknown command: {line}")
        else:
            _print_hits(engine, spark, line, mode, k, source)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="build an index of TSV files")
    p.add_argument("source")
    p.add_argument("path")
    p = sub.add_parser("blocks", help="write the text blocks of TSV files")
    p.add_argument("source")
    p.add_argument("path")
    p.add_argument("--max-postings", type=int, default=5_000_000, help="postings of a block")
    p = sub.add_parser("merge", help="merge text blocks into an index")
    p.add_argument("blocks")
    p.add_argument("source", help="the TSV files that the blocks were made of, for the document table")
    p.add_argument("path")
    p = sub.add_parser("search", help="search an index")
    p.add_argument("path")
    p.add_argument("query", nargs="?")
    p.add_argument("--mode", choices=sorted(search.MODES), default="disjunctive")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--source", help="the TSV files, for snippets")
    p.add_argument("--interactive", action="store_true", help="read queries, and the commands /k N and /mode NAME, from standard input until an empty line")
    p = sub.add_parser("stats", help="figures of an index")
    p.add_argument("path")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "index":
        search.SearchEngine.from_passages(src.read_tsv(spark, args.source)).save(args.path)
        return 0
    if args.command == "blocks":
        index.write_blocks(src.read_tsv(spark, args.source), args.path, args.max_postings)
        return 0
    if args.command == "merge":
        merged = index.merge_blocks(src.read_block_files(spark, args.blocks))
        search.SearchEngine(merged, index.doc_table(src.read_tsv(spark, args.source))).save(args.path)
        return 0
    if args.command == "stats":
        spark.read.json(f"{args.path}/stats").show(truncate=False)
        return 0
    engine = search.SearchEngine.load(spark, args.path)
    if args.query:
        _print_hits(engine, spark, args.query, args.mode, args.k, args.source)
    if args.interactive:
        _interactive(engine, spark, sys.stdin, args.mode, args.k, args.source)
    return 0


if __name__ == "__main__":
    sys.exit(main())
