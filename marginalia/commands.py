"""Commands over an index: python -m marginalia COMMAND --root FOLDER --catalog package.module:function ...

The function takes a session and gives the catalogue, or (catalogue, settings) or (catalogue, settings, embedder). Exit codes
are 0 for success and 1 for a failure: of doctor if any check fails, of verify if drift is left, of forget and dependencies if
there is no such document, of sync and rebuild if a document failed.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from marginalia.config import EngineConfig
from marginalia.index import Index

Print = Callable[[str], None]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia", description="Look after a document index.")
    p.add_argument("--root", required=True, help="the folder of the index, shared by all executors")
    p.add_argument("--catalog", required=True, help="package.module:function that gives the catalogue")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("status")
    commands.add_parser("doctor")
    verify = commands.add_parser("verify")
    verify.add_argument("type", nargs="?")
    verify.add_argument("--sample", type=int)
    verify.add_argument("--fix", action="store_true")
    sync = commands.add_parser("sync")
    sync.add_argument("type", nargs="?")
    sync.add_argument("--id", action="append")
    sync.add_argument("--dependency", help="Type:id, in place of a type")
    sync.add_argument("--chunk", type=int, help="texts a call of the embedder")
    rebuild = commands.add_parser("rebuild")
    rebuild.add_argument("type", nargs="?")
    commands.add_parser("prune")
    for name in ("forget", "dependencies"):
        one = commands.add_parser(name)
        one.add_argument("type")
        one.add_argument("id")
    commands.add_parser("index").add_argument("type")
    return p


def run(index: Index, args: argparse.Namespace, tell: Print = print) -> int:
    """The exit code of a parsed command."""
    return {"status": _status, "doctor": _doctor, "verify": _verify, "sync": _sync, "rebuild": _sync, "prune": _prune, "forget": _forget, "dependencies": _dependencies, "index": _index}[args.command](index, args, tell)


def _status(index: Index, args: argparse.Namespace, tell: Print) -> int:
    for name, value in index.status().items():
        tell(f"{name}: {value}")
    return 0


def _doctor(index: Index, args: argparse.Namespace, tell: Print) -> int:
    checks = index.doctor()
    for check, level, detail in checks:
        tell(f"[{level}] {check}: {detail}")
    return int(any(level == "FAIL" for _, level, _ in checks))


def _verify(index: Index, args: argparse.Namespace, tell: Print) -> int:
    found = index.verify(args.type, args.sample, args.fix)
    for entity_type, entity_id, drift in found["report"]:
        tell(f"{entity_type} {entity_id}: {', '.join(drift)}")
    if found["more"]:
        tell(f"... and {found['more']} more")
    tell(", ".join(f"{k} {found[k]}" for k in ("checked", "drifted", "fixed", "orphaned")))
    return int(not found["ok"])


def _sync(index: Index, args: argparse.Namespace, tell: Print) -> int:
    if args.command == "rebuild":
        tallies = index.rebuild(args.type)
    elif args.dependency:
        if args.type or args.id:
            raise ValueError("a dependency stands in place of a type and ids")
        tallies = index.sync_affected(args.dependency)
    else:
        if args.id and not args.type:
            raise ValueError("ids need a type")
        tallies = index.sync(args.type, args.id)
    if not tallies:
        tell("nothing to do")
    for t, tally in tallies.items():
        tell(f"{t}: " + ", ".join(f"{k} {v}" for k, v in tally.items()))
        if index.embedder:
            tell(f"{t}: " + ", ".join(f"{k} {v}" for k, v in index.embed(t, args.id if args.command == "sync" else None, record=True).items()))
    return int(any(t["failed"] for t in tallies.values()))


def _prune(index: Index, args: argparse.Namespace, tell: Print) -> int:
    gone = index.prune()
    for t in index.entity_types():
        tell(f"{t}: {gone[t]} pruned" if t in gone else f"{t}: unknown, left alone")
    return 0


def _forget(index: Index, args: argparse.Namespace, tell: Print) -> int:
    gone = index.forget(args.type, [args.id])
    tell(f"{args.type} {args.id}: " + ("forgotten" if gone else "has no document"))
    return int(not gone)


def _dependencies(index: Index, args: argparse.Namespace, tell: Print) -> int:
    try:
        rows = index.dependencies_of(args.type, args.id).collect()
    except KeyError as e:
        tell(str(e.args[0]))
        return 1
    for r in rows:
        tell(f"{r.dependency_type} {r.dependency_id}")
    if not rows:
        tell("no dependencies")
    return 0


def _index(index: Index, args: argparse.Namespace, tell: Print) -> int:
    tell(f"{args.type}: {index.build_vector_index(args.type)} cells")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, tell: Print = print) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("marginalia").getOrCreate()
    module, _, function = args.catalog.partition(":")
    given = getattr(importlib.import_module(module), function)(spark)
    catalog, config, embedder = (*given, None, None)[:3] if isinstance(given, tuple) else (given, None, None)
    config = config or EngineConfig()
    if getattr(args, "chunk", None):
        config = config.with_(auto_batch_size=args.chunk)
    return run(Index(spark, args.root, catalog, config, embedder), args, tell)
