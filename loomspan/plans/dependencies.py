"""Evidence that a declared package is used: imports, scripts, configuration, documents, peers and overrides."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.patterns import indexed
from loomspan.sources import projects, tables
from loomspan.sources.globs import any_of
from loomspan.sources.projects import Project, is_source
from loomspan.sources.resolver import package_of

# What parts commands, and variables set before one.
_SPLIT = re.compile(r"\s*(?:&&|\|\||[;&|])\s*")
_SET = re.compile(r"[A-Z_][A-Z0-9_]*=")


def declared(project: Project) -> dict[str, str]:
    """Section of each declared package; the one for development wins."""
    return {d: s for s in ("dependencies", "devDependencies") for d in project.package.section(s)}


def binaries(project: Project, names: set[str]) -> dict[str, str]:
    """Package of each binary: those that tools are known by, and those of installed packages."""
    out = dict(tables.BINARIES)
    for name in names:
        found = project.data.get(f"node_modules/{name}/package.json", {}).get("bin")
        if isinstance(found, str):
            out[name.rpartition("/")[2]] = name
        elif isinstance(found, dict):
            out |= dict.fromkeys(found, name)
    return out


def commanded(command: str, names: set[str], bins: dict[str, str]) -> Iterator[str]:
    """Declared packages whose binaries a shell command runs."""
    for part in _SPLIT.split(command):
        words = part.split()
        if words and posixpath.basename(words[0]) in tables.ENV_WRAPPERS:
            yield bins.get(posixpath.basename(words[0]), posixpath.basename(words[0]))
            words.pop(0)
        while words and _SET.match(words[0]):
            words.pop(0)
        if not words:
            continue
        first = posixpath.basename(words[0])
        second = posixpath.basename(words[1]) if first in ("npx", "pnpx", "bunx") and len(words) > 1 else ""
        for b in (first, second):
            yield from (p for p in (bins.get(b), tables.BINARIES_TOO.get(b), b) if p in names)
        if len(words) > 1 and second and words[1] in names:
            yield words[1]


def token(name: str) -> re.Pattern[str]:
    """A package's name as a word of a command line, maybe with a path after it (a fixed form)."""
    return re.compile(rf"(?:^|[\s='\"`(,;:|&]){re.escape(name)}(?:/[^\s'\"`]*)?(?=$|[\s='\"`),;:|&])")


def imported(name: str) -> str:
    """A regular expression of statements that import a package (fixed forms)."""
    whole = re.escape(name) + "(?:/[^'\"]*)?"
    return rf"(?:\bfrom\s+|\bimport\s+(?:[^'\";\n]*?\sfrom\s+)?|\brequire\s*\(\s*|\bimport\s*\(\s*)['\"]{whole}['\"]|\brequire\s*\(\s*`{re.escape(name)}"


def configured(project: Project) -> set[str]:
    """Declared packages that scripts, package.json sections, configuration files and compilers name."""
    names, out = set(declared(project)), set()
    bins = binaries(project, names)
    projects = [project, *([project.outer] if project.outer else [])]
    for p in projects:
        for package in (p.package, *p.workspaces):
            for command in package.scripts:
                out |= set(commanded(command, names, bins)) | {n for n in names if token(n).search(command)}
            for s in tables.SECTIONS:
                if isinstance(package.data.get(s), dict | list):
                    text = json.dumps(package.data[s])
                    out |= {n for n in names if n in text}
        evidence = re.compile(any_of(tables.EVIDENCE, dot=True))
        stems = tuple(f"{s}." for s in tables.CONFIG_STEMS)
        for path, text in p.texts.items():
            base = posixpath.basename(path)
            if "node_modules/" in path:
                continue
            if path.count("/") <= 2 and evidence.match(path) or base.startswith(stems) or re.match(r"\.[\w-]*rc\.", base.lower()):
                out |= {n for n in names if n in text}
            if base == "project.json":
                out |= {n for n in names if n in text}
                for s in _strings(p.data.get(path)):
                    out |= set(commanded(s, names, bins))
            if base.startswith(("tsconfig", "jsconfig")) and path.count("/") <= 3:
                data = p.data.get(path, {})
                extends = data.get("extends")
                out |= {package_of(e) for e in ([extends] if isinstance(extends, str) else extends if isinstance(extends, list) else []) if isinstance(e, str) and not e.startswith((".", "/"))}
                options = data.get("compilerOptions") if isinstance(data.get("compilerOptions"), dict) else {}
                out |= {options["jsxImportSource"]} if isinstance(options.get("jsxImportSource"), str) else set()
                out |= {package_of(t) for t in options.get("types") or [] if isinstance(t, str)}
    return out & names


def implied(project: Project, used: set[str], jsx: bool) -> set[str]:
    """Declared packages that used ones need: React's own, peers, companions and overrides."""
    names, out = declared(project), set(used)
    if jsx:
        out |= {"react", "react-dom", "react-native", "react-native-web"} & set(names)
    if "react-dom" in names and tables.WEB_FRAMEWORKS & (set(names) | out):
        out.add("react-dom")
    if {"react", "react-dom"} <= set(names):
        peers = project.package.section("peerDependencies")
        out |= {n for n in ("react", "react-dom") if n in peers and names[n] == "devDependencies"}
    installed = {p for n in names if n in out for p in _section(project.data.get(f"node_modules/{n}/package.json"), "peerDependencies")}
    out |= installed & set(names)
    out |= {p for n, ps in tables.PEERS.items() if n in out for p in ps.split()} & set(names)
    out |= {p for n, p in tables.COMPANIONS.items() if n in out} & set(names)
    return out | {to for _, to in overrides(project) if to in names}


def overrides(project: Project) -> Iterator[tuple[str, str]]:
    """Packages that others are replaced by: in overrides, resolutions, and those of a workspace file."""

    def walk(name: str, x: object) -> Iterator[tuple[str, str]]:
        if isinstance(x, str):
            plain = x.strip().strip("\"'").removeprefix("npm:")
            at = plain.find("@", 1)
            to = plain[:at] if at > 0 else plain
            if to and (not to.startswith("@") or "/" in to):
                yield name, to
        elif isinstance(x, dict):
            for k, v in x.items():
                yield from walk(k, v)

    for p in (project, *([project.outer] if project.outer else [])):
        for package in (p.package, *p.workspaces):
            for section in (package.data.get("overrides"), package.data.get("resolutions"), package.section("pnpm").get("overrides")):
                yield from walk("", section)
        for file in ("pnpm-workspace.yaml", "pnpm-workspace.yml"):
            lines = p.texts.get(file, "").split("\n")
            for i, line in enumerate(lines):
                if line.strip() == "overrides:":
                    indent = len(line) - len(line.lstrip())
                    for inner in lines[i + 1 :]:
                        if inner.strip() and len(inner) - len(inner.lstrip()) <= indent:
                            break
                        key, colon, value = inner.strip().rpartition(": ")
                        if colon and not key.startswith("#"):
                            yield from walk(key.strip("\"'"), value)


def unused(spark: SparkSession, project: Project, used: set[str], jsx: bool) -> DataFrame:
    """package, section of declared packages without evidence, of which no text imports anything either.

    used: packages that sources import. The last search reads sources and documents anew, for the few names left.
    """
    names = declared(project)
    known = implied(project, (used & set(names)) | configured(project), jsx)
    left = [n for n in names if n not in known and n not in tables.IMPLICIT and not n.startswith(tables.IMPLICIT_STARTS) and not n.endswith(tables.IMPLICIT_ENDS)]
    rows = spark.createDataFrame([(n, names[n]) for n in left], "package string, section string")
    wanted = [p for p in project.paths if p.endswith((".md", ".mdx")) and posixpath.basename(p) != "CHANGELOG.md" or is_source(p) and not p.endswith(".d.ts")]
    if not left or not wanted:
        return rows
    read = projects.texts(spark, project.root, wanted)
    patterns = spark.createDataFrame([(n, imported(n)) for n in left], "name string, pattern string")
    found = indexed(read.select("content"), "content", patterns, "pattern", "name").select(F.col("name").alias("package")).distinct()
    return rows.join(found, "package", "left_anti")


def _section(x: object, name: str) -> dict:
    got = x.get(name) if isinstance(x, dict) else None
    return got if isinstance(got, dict) else {}


def _strings(x: object) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict | list):
        for v in x.values() if isinstance(x, dict) else x:
            yield from _strings(v)
