"""Command line: ``python -m tessera read|convert|schema|count|run``."""

from __future__ import annotations

import argparse
from pathlib import Path

from . import sinks
from .plans import json_plan
from .session import session
from .sources import files

READERS = {"csv": files.from_csv, "json": files.from_json, "parquet": files.from_parquet, "text": files.from_text, "txt": files.from_text, "xml": files.from_xml}
WRITERS = {"csv": sinks.to_csv, "json": sinks.to_json, "parquet": sinks.to_parquet, "text": sinks.to_text, "txt": sinks.to_text, "xml": sinks.to_xml}


def _format(path: str, given: str | None, known: dict) -> str:
    name = given or Path(path).suffix.lstrip(".")
    if name not in known:
        raise SystemExit(f"unknown format {name!r}; one of {', '.join(sorted(known))}")
    return name


def _options(args: argparse.Namespace, kind: str) -> dict:
    if kind == "csv":
        return {k: v for k, v in {"separator": args.csv_separator, "enclosure": args.csv_enclosure, "with_header": not args.csv_no_header}.items() if v is not None}
    if kind == "json" and args.json_pointer:
        return {"pointer": args.json_pointer}
    if kind == "xml" and args.xml_node_path:
        return {"node_path": args.xml_node_path}
    return {}


def _read(spark, args):
    kind = _format(args.input, args.input_format, READERS)
    frame = READERS[kind](spark, args.input, **_options(args, kind))
    frame = frame.auto_cast() if args.auto_cast else frame
    return frame.limit(args.limit) if args.limit else frame


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("read", "convert", "schema", "count"):
        p = commands.add_parser(name)
        p.add_argument("input")
        if name == "convert":
            p.add_argument("output")
            p.add_argument("--output-format")
            p.add_argument("--mode", default="exception_if_exists")
        p.add_argument("--input-format")
        p.add_argument("--limit", type=int)
        p.add_argument("--truncate", type=int, default=20)
        p.add_argument("--auto-cast", action="store_true")
        p.add_argument("--csv-separator")
        p.add_argument("--csv-enclosure")
        p.add_argument("--csv-no-header", action="store_true")
        p.add_argument("--json-pointer")
        p.add_argument("--xml-node-path")
    commands.add_parser("run").add_argument("plan", help="a JSON plan file")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "run":
        json_plan.from_json(spark, Path(args.plan).read_text(encoding="utf-8")).run()
        return 0
    frame = _read(spark, args)
    if args.command == "read":
        print(frame.display(args.limit or 20, args.truncate), end="")
    elif args.command == "schema":
        print(frame.schema().ascii(), end="")
    elif args.command == "count":
        print(frame.count())
    else:
        kind = _format(args.output, args.output_format, WRITERS)
        frame.mode(args.mode).write(WRITERS[kind](args.output))
    return 0
