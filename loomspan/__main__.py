"""Command line: analyse a project and print its findings.

Exit codes: 0, 1 if --fail-on-issues or --fail-on-cycles finds something, 2 if the root is no folder.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from loomspan.plans.analyze import ISSUES, Options, analyze
from loomspan.plans.entries import DEFAULT
from loomspan.sources import projects

#: Findings of a kind that a person is shown, and all that JSON has.
SHOWN = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan", description="Find unused files, exports and dependencies, cycles and duplicates in JavaScript projects.")
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("-e", "--entry", nargs="+", default=list(DEFAULT), help="globs of entries")
    p.add_argument("-i", "--ignore", nargs="+", default=[], help="globs of files to leave out")
    p.add_argument("--extensions", nargs="+", default=[], help="extensions to read")
    p.add_argument("--tsconfig", help="configuration with path mappings")
    p.add_argument("--paths", nargs="+", default=[], metavar="ALIAS=TARGET", help="path mappings, such as @app/*=src/*")
    p.add_argument("--report-types", action="store_true")
    p.add_argument("--include-entry-exports", action="store_true")
    p.add_argument("--compat", action="store_true", help="report duplicate blocks of every interval of the suffix array, nested ones as well")
    p.add_argument("--json", action="store_true")
    p.add_argument("--fail-on-issues", action="store_true")
    p.add_argument("--fail-on-cycles", action="store_true")
    return p


def _mappings(given: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for entry in given:
        alias, _, target = entry.partition("=")
        if alias and target:
            out.setdefault(alias, []).append(target)
        else:
            print(f"left out, as it is no alias=target: {entry}", file=sys.stderr)
    return out


def _title(name: str) -> str:
    return "".join(f" {c.lower()}" if c.isupper() else c for c in name)


def _said(item: dict) -> str:
    """A finding on one line: where, what, and the rest in brackets."""
    at = item.get("path") or ""
    line = f":{item['line']}" if item.get("line") else f":{item['start_line']}-{item['end_line']}" if item.get("start_line") else ""
    rest = {k: v for k, v in item.items() if k not in ("path", "line", "start_line", "end_line") and v not in (None, "", [])}
    what = [" -> ".join(map(str, v)) if isinstance(v, list) and k in ("files", "paths") else str(v) if k in ("name", "export", "package", "flag", "member") else f"{k}={v}" for k, v in rest.items()]
    return "  ".join(x for x in (f"{at}{line}", *what) if x)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    root = Path(given.root).resolve()
    if not root.is_dir():
        print(f"no such folder: {root}", file=sys.stderr)
        return 2
    if not (root / "package.json").is_file():
        print("no package.json: dependencies are not checked", file=sys.stderr)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    options = Options(entries=tuple(given.entry), ignore=tuple(given.ignore), extensions=tuple(given.extensions), paths=_mappings(given.paths), tsconfig=given.tsconfig, report_types=given.report_types, entry_exports=given.include_entry_exports, compat=given.compat)
    found = analyze(spark, projects.load(str(root)), options)
    issues = cycles = False
    if given.json:
        print("{")
    for nth, (name, df) in enumerate(sorted(found.items())):
        if given.json:
            print(("" if nth == 0 else ",\n") + json.dumps(name) + ": [", end="")
            some = False
            for row in df.toLocalIterator():
                print((",\n  " if some else "\n  ") + json.dumps(row.asDict(recursive=True)), end="")
                some = True
            print("]", end="")
        else:
            rows = df.limit(SHOWN + 1).collect()
            some = bool(rows)
            if rows:
                print(f"{len(rows) if len(rows) <= SHOWN else f'more than {SHOWN}'}{_title(name) if name[0].isupper() else ' ' + _title(name)}")
                for row in rows[:SHOWN]:
                    print("  " + _said(row.asDict(recursive=True)))
                print()
        issues |= some and name in ISSUES
        cycles |= some and name == "circularDependencies"
    print("\n}" if given.json else "" if issues or cycles else "Nothing unused, and no circular imports.")
    return int(given.fail_on_issues and issues or given.fail_on_cycles and cycles)


if __name__ == "__main__":
    sys.exit(main())
