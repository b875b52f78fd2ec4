"""Command line: ``python -m codesift scan FOLDER``, ``report``, ``rules`` and ``init``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from codesift import config
from codesift.operators import reports
from codesift.operators.findings import exit_code, summary
from codesift.plans.scan import scan
from codesift.session import ship, written
from codesift.sources import rules


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codesift")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan", help="scan a folder")
    s.add_argument("folder")
    s.add_argument("--preset", choices=sorted(config.PRESETS))
    s.add_argument("--languages", nargs="*", help="only these languages")
    s.add_argument("--include", nargs="*", help="globs of which one must fit")
    s.add_argument("--exclude", nargs="*", help="ignore rules, in place of the defaults")
    s.add_argument("--severity", nargs="*", help="security findings of these severities only")
    s.add_argument("--security", action="store_true", help="the security scanner alone")
    s.add_argument("--quality", action="store_true", help="the quality scanner alone")
    s.add_argument("--deep", action="store_true", help="follow data through files")
    s.add_argument("--rules", help="a rule file or a folder of them")
    s.add_argument("--advisories", help="a JSON table of advisories; turns the cve scanner on")
    s.add_argument("--format", choices=sorted(reports.FORMATS), default="console")
    s.add_argument("--output", help="the report: one file if it ends in .json, .sarif, .csv or .txt, else a folder of parts; printed if there is none")
    r = commands.add_parser("report", help="convert a JSON report")
    r.add_argument("source")
    r.add_argument("target")
    r.add_argument("--format", choices=sorted(reports.FORMATS), default="csv")
    listed = commands.add_parser("rules", help="list rules")
    for name in ("category", "severity", "language", "scanner"):
        listed.add_argument(f"--{name}")
    i = commands.add_parser("init", help="write a configuration file")
    i.add_argument("folder", nargs="?", default=".")
    return p


def overrides(args: argparse.Namespace) -> dict:
    """What the flags say, over the configuration; ``--severity`` asks for the security scanner."""
    found = {k: v for k, v in (("languages", args.languages), ("include", args.include), ("exclude", args.exclude), ("severities", args.severity), ("rules_path", args.rules)) if v is not None}
    if args.security or args.quality:
        found |= {"security": args.security or bool(args.severity), "quality": args.quality}
    if args.deep:
        found["deep"] = True
    if args.advisories:
        found["cve"] = True
    return found


def main(argv: list[str] | None = None) -> int:
    """Exit code: 1 if a finding is critical or high, 2 on an error, else 0."""
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            print(config.init(args.folder))
            return 0
        spark = SparkSession.builder.appName("codesift").getOrCreate()
        ship(spark)
        if args.command == "rules":
            table = rules.rules_table(spark, rules.read_rules())
            rules.listed(table, args.category, args.severity, args.language, args.scanner).orderBy("id").show(1000, truncate=False)
            return 0
        if args.command == "report":
            reports.convert_report(spark, args.source, args.target, args.format)
            return 0
        from codesift.operators.dependencies import ADVISORY

        chosen = config.load(args.folder, args.preset, overrides(args))
        advisories = spark.read.schema(ADVISORY).json(args.advisories) if args.advisories else None
        result = scan(spark, args.folder, chosen, advisories=advisories)
        # The scan runs once; report, summary and exit code read its findings.
        found = written(result.findings, "findings")
        totals = summary(found, result.files)
        if args.output and reports.is_file(args.output):
            reports.write_file(found, args.output, args.format, totals, {"target": args.folder, "config": asdict(chosen)}, overwrite=True)
        elif args.output:
            reports.write_report(found, args.output, args.format)
        else:
            for row in reports.FORMATS[args.format](found).toLocalIterator():
                print(row.value)
            reports.bars(totals).orderBy("dimension", "value").show(100, truncate=False)
        return exit_code(found).first().exit_code
    except Exception as error:
        print(f"codesift: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
