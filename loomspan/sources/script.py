"""Facts of one JavaScript or TypeScript file: a scanner and a reader of its import and export statements.

The scanner yields tokens (kind, text, offset); the reader walks them once. It never raises on odd
input: what it cannot read it skips.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from loomspan.sources import patterns, shapes

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')|(?P<template>`(?:[^`\\$]|\\.|\$(?!\{))*+(?:`|\$\{)?)"
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|\.\.\.|\?\?|&&|\|\||[=!]==?|[^\s\w])",
    re.S,
)
#: What follows a value in a template: text up to the next value or the end.
_REST = re.compile(r"\}(?:[^`\\$]|\\.|\$(?!\{))*+(?:`|\$\{)?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash divides; after anything else it begins a regular expression.
_VALUE_END = frozenset(")]}")
_DECLARES = frozenset("const let var function class interface type enum namespace abstract async declare".split())
_BLIND = {"string": "S", "template": "S", "number": "N"}


@dataclass
class Facts:
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    references: set[str] = field(default_factory=set)
    constants: list[dict] = field(default_factory=list)
    smells: list[dict] = field(default_factory=list)
    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    inline_types: list[dict] = field(default_factory=list)
    flags: list[dict] = field(default_factory=list)
    enum_members: list[dict] = field(default_factory=list)
    class_members: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)
    filenames: list[str] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)


_CSS = re.compile(r"@(?:import|use|forward|plugin|reference|config)\s+(?:url\(\s*)?[\"']?([^\"'\s;)]+)")
def read_css(path: str, source: str) -> Facts:
    """Imports of a style sheet; those of other hosts are left out. A bare name is tried beside the file."""
    facts = Facts()
    for m in _CSS.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", "", source, flags=re.S)):
        spec = m[1]
        if "//" not in spec:
            beside = spec if spec.startswith((".", "@", "~")) else f"./{spec}"
            facts.imports.append({"specifier": spec, "target": target_of(path, beside), "kind": "css", "type_only": False, "line": source.count("\n", 0, m.start()) + 1, "names": []})
    return facts


def glob_regex(path: str, pattern: str) -> tuple[str, str] | None:
    """Of a relative glob: the folder it starts in, and a regular expression of the paths it takes."""
    whole = target_of(path, pattern)
    if whole is None:
        return None
    fixed = whole.split("*")[0].rpartition("/")[0]
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = re.sub(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|[^*?{]+", lambda m: steps.get(m[0]) or ("(?:" + "|".join(map(re.escape, m[0][1:-1].split(","))) + ")" if m[0][0] == "{" else re.escape(m[0])), whole)
    return fixed, f"^{body}$"


def scan(source: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    """Tokens and comments. The values in a template are code; its text is tokens of their own around them."""
    out: list[tuple[str, str, int]] = []
    comments: list[tuple[str, int]] = []
    at, depth, templates = 0, 0, []
    while m := _TOKEN.search(source, at):
        kind, text = m.lastgroup, m[0]
        if text == "/" and (not out or out[-1][0] == "punct" and out[-1][1] not in _VALUE_END or out[-1][0] == "template" and out[-1][1].endswith("${") or out[-1][1] in ("return", "typeof", "case", "=>")):
            r = _REGEX.match(source, m.start())
            if r:
                out.append(("string", r[0], m.start()))
                at = r.end()
                continue
        if text == "}" and templates and templates[-1] == depth:
            r = _REST.match(source, m.start())
            templates.pop()
            kind, text, at = "template", r[0], r.end()
        else:
            at = m.end()
            depth += (text == "{") - (text == "}") if kind == "punct" else 0
        if kind == "template" and text.endswith("${"):
            templates.append(depth)
        if kind == "comment":
            comments.append((text, m.start()))
        else:
            out.append((kind, text, m.start()))
    return out, comments


_SCRIPT = re.compile(r"<script\b([^>]*?)(?:/>|>(.*?)</script>)", re.S | re.I)
_SRC = re.compile(r"\bsrc\s*=\s*[\"']([^\"']+)[\"']", re.I)


def embedded(path: str, source: str) -> str:
    """The scripts of a Vue, Svelte, Astro or MDX file, on the lines where they stand; other files as they are."""
    kind = path.rpartition(".")[2]
    if kind not in ("vue", "svelte", "astro", "mdx"):
        return source
    if kind == "mdx":
        kept, depth = [], 0
        for text in source.split("\n"):
            begins = re.match(r"\s*(import|export)[\s{]", text)
            if depth > 0 or begins:
                depth = max(0, depth + text.count("{") - text.count("}"))
                kept.append(text)
                depth = 0 if " from " in text else depth
            else:
                kept.append("")
        return "\n".join(kept)
    out, at = [], 0
    front = re.match(r"---\r?\n(.*?)\r?\n---", source, re.S) if kind == "astro" else None
    if front:
        out.append("\n" * source.count("\n", 0, front.start(1)) + front[1])
        at = front.end(1)
    for m in _SCRIPT.finditer(source, front.end() if front else 0):
        start = m.start(2) if m[2] is not None else m.start()
        out.append("\n" * source.count("\n", at, start))
        src = _SRC.search(m[1]) if kind == "astro" else None
        out.append((f"import {src[1]!r};" if src else "") + (m[2] or ""))
        at = m.end(2) if m[2] is not None else m.start()
    return "".join(out)


def mock_sibling(specifier: str) -> str | None:
    """The file in `__mocks__` beside a mocked module that a test runner takes without being told."""
    folder, slash, name = specifier.rpartition("/")
    return f"{folder}/__mocks__/{name}" if slash and name and "__mocks__" not in folder.split("/") and "://" not in specifier and not specifier.startswith("data:") else None


def target_of(path: str, specifier: str) -> str | None:
    """The path a relative specifier points at, without extension rules; null for bare ones."""
    clean = re.sub(r"\?.*$", "", specifier.rpartition("!")[2])
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), clean)) if clean.startswith(".") else None


def _list(toks: list[tuple[str, str, int]], i: int, same: list[tuple[str, int]]) -> tuple[list[tuple[str, str, bool]], int]:
    """Names of a brace list from its opening brace: (name, alias, type only), and the place after it.

    Names given as aliases of themselves are added to `same`.
    """
    names, part, i = [], [], i + 1
    while i < len(toks):
        text = toks[i][1]
        if text in (",", "}"):
            if part:
                typed = part[0] == "type" and len(part) > 1 and part[1] != "as"
                part = part[typed:]
                if len(part) > 2 and part[1] == "as" and part[0] == part[2]:
                    same.append((part[0], toks[i][2]))
                names.append((part[0].strip("\"'"), part[2].strip("\"'") if len(part) > 2 and part[1] == "as" else part[0].strip("\"'"), typed))
                part = []
            if text == "}":
                return names, i + 1
        else:
            part.append(text)
        i += 1
    return names, i


def _bound(code: patterns.Code, i: int) -> tuple[list[tuple[str, int]], int]:
    """Names that a pattern binds, taken apart however deep, and the place after it."""
    if code.is_name(i):
        return [(code.at(i), i)], i + 1
    if code.at(i) not in ("{", "[") or i not in code.mate:
        return [], i + 1
    out, k, end, array = [], i + 1, code.mate[i], code.at(i) == "["
    while k < end:
        while k < end and code.at(k) in (",", "..."):
            k += 1
        if k >= end:
            break
        if not array and code.at(k + 1) == ":" and code.at(k) != "[":
            k += 2
        elif not array and code.at(k) == "[" and k in code.mate:
            k = code.mate[k] + 2
        names, k = _bound(code, k)
        out += names
        while k < end and code.at(k) != ",":  # a default
            k = code.mate[k] + 1 if code.at(k) in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1
    return out, end + 1


def _declared(code: patterns.Code, i: int) -> Iterator[tuple[str, int]]:
    """Names of a declaration from its first declarator on, which begins at token i."""
    while i < len(code.toks):
        names, k = _bound(code, i)
        yield from names
        while True:
            if k >= len(code.toks) or code.at(k) == ";" or code.at(k) in (")", "}", "]") or k > i + 1 and shapes._ends(code, k):
                return
            if code.at(k) == "," and (code.is_name(k + 1) and (code.at(k + 2) in ("=", ":", ",", ";", "") or code.breaks(k + 2)) or code.at(k + 1) in ("{", "[") and code.at(code.mate.get(k + 1, k) + 1) in ("=", ":")):
                i = k + 1
                break
            k = code.mate[k] + 1 if code.toks[k][0] == "punct" and code.at(k) in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1


def _default_name(code: patterns.Code, i: int) -> str | None:
    """The local name that `export default` before token i exports, also through calls that wrap it."""
    while code.at(i) in ("async", "function", "class", "abstract", "*"):
        i += 1
        if code.at(i - 1) in ("function", "class"):
            i += code.at(i) == "*"
            return code.at(i) if code.is_name(i) and code.at(i) != "extends" else None
    if not code.is_name(i):
        return None
    _, k = code.dotted_from(i)
    return _wrapped(code, k) if code.at(k) == "(" else code.at(i) if k == i + 1 and code.at(k) != "=>" else None


def _wrapped(code: patterns.Code, opens: int) -> str | None:
    """The first name among the arguments of a call, or of calls among them, or of a call of its result."""
    end, k = code.mate.get(opens, opens), opens + 1
    while k < end:
        name, after = code.dotted_from(k)
        if name and code.at(after) in (",", ")") and after == k + 1:
            return name
        if name and code.at(after) == "(" and (got := _wrapped(code, after)):
            return got
        while k < end and code.at(k) != ",":
            k = code.mate[k] + 1 if code.at(k) in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1
        k += 1
    return _wrapped(code, end + 1) if end > opens and code.at(end + 1) == "(" else None


# Fixed value: texts that look like the name of a source file.
_FILENAME = re.compile(r"(?<![./@\w-])[\"'`]([a-z][\w-]*\.(?:ts|tsx|js|jsx|mts|mjs|cts|cjs))[\"'`]")
# Exports that frameworks read by name, which are no constants to share.
_RESERVED = frozenset("dynamic dynamicParams revalidate runtime fetchCache preferredRegion maxDuration metadata viewport generateStaticParams generateMetadata config loader action links meta headers handle shouldRevalidate ErrorBoundary HydrateFallback Layout".split())


def _literal(code: patterns.Code, i: int) -> tuple[str, int] | None:
    """A literal worth sharing that begins at token i, and the place after it: long text, a large number, or a list of literals."""
    kind, text = code.toks[i][:2] if i < len(code.toks) else ("", "")
    if kind in ("string", "template") and text[:1] in "\"'`" and text[:1] == text[-1:]:
        return (text[1:-1] if kind == "string" else text, i + 1) if len(text) >= 10 else None
    minus = text == "-" and code.toks[i + 1 : i + 2] and code.toks[i + 1][0] == "number"
    if kind == "number" or minus:
        digits = code.at(i + minus).replace("_", "").rstrip("n")
        try:
            value = float(int(digits, 0)) if re.fullmatch(r"0[xXoObB]\w+", digits) else float(digits)
        except ValueError:
            return None
        return (f"{'-' * minus}{value:g}", i + 1 + minus) if value >= 1000 else None
    if text == "[" and i in code.mate and code.mate[i] > i + 1:
        inner = [code.toks[k] for k in range(i + 1, code.mate[i]) if code.at(k) != ","]
        if all(k in ("string", "number") or t in ("true", "false", "null") for k, t, _ in inner):
            return "[" + ",".join(t for _, t, _ in inner) + "]", code.mate[i] + 1
    return None


def read(path: str, source: str) -> Facts:
    """All facts of the file at `path`."""
    source = embedded(path, source)
    toks, comments = scan(source)
    facts, starts = Facts(), [0, *(m.end() for m in re.finditer("\n", source))]
    from bisect import bisect_right

    def line(offset: int) -> int:
        return bisect_right(starts, offset)

    def imported(spec: str, kind: str, offset: int, names: list[tuple[str, str, bool]], type_only: bool = False) -> None:
        facts.imports.append({"specifier": spec, "target": target_of(path, spec), "kind": kind, "type_only": type_only, "line": line(offset), "names": [{"name": n, "alias": a, "type_only": t or type_only} for n, a, t in names]})

    def globbed(pattern: str, offset: int) -> None:
        found = glob_regex(path, pattern) if pattern.startswith(".") else None
        if found:
            facts.imports.append({"specifier": found[1], "target": found[0], "kind": "glob", "type_only": False, "line": line(offset), "names": []})

    def exported(name: str, offset: int, **more: object) -> None:
        facts.exports.append({"name": name, "original": None, "source": None, "target": None, "type_only": False, "line": line(offset), "local": None} | more)

    for text, offset in comments:
        for tag, confidence in (("@ts-ignore", "high"), ("@ts-nocheck", "medium"), ("@ts-expect-error", "low")):
            if tag in text and (tag != "@ts-expect-error" or re.search(r"@ts-expect-error\s*(\*/)?$", text)):
                facts.smells.append({"kind": "escape-hatch", "detail": tag, "line": line(offset), "confidence": confidence})
    text_at = lambda k: toks[k][1] if 0 <= k < len(toks) else ""
    code = patterns.Code(toks, line)
    lists: list[tuple[int, int]] = []
    named: set[int] = set()
    is_string = lambda k: 0 <= k < len(toks) and toks[k][0] == "string" and toks[k][1][:1] in "\"'"
    depth, i, spaces, own, same, exporting = 0, 0, {}, [], [], False
    def constant(k: int) -> None:
        """Literals that the declaration of token k, a `const`, gives to names."""
        for name, at in _declared(code, k + 1):
            put = at + 1
            if code.at(put) == ":":
                while put < len(toks) and code.at(put) not in ("=", ";") and not shapes._ends(code, put):
                    put += 1
            if code.at(put) == "=" and name not in _RESERVED and (found := _literal(code, put + 1)):
                after = found[1] + 2 * (code.at(found[1]) == "as" and code.at(found[1] + 1) == "const")
                if after >= len(toks) or code.at(after) in (";", ",", "}") or code.breaks(after):
                    facts.constants.append({"name": name, "literal": found[0], "line": line(toks[at][2])})

    while i < len(toks):
        kind, text, offset = toks[i]
        nth = i
        if exporting and depth == 0 and (text == ";" or i and line(toks[i - 1][2] + len(toks[i - 1][1]) - 1) < line(offset) and (toks[i - 1][0] != "punct" or toks[i - 1][1] in ")]}") and kind == "name"):
            exporting = False
        if kind == "punct" and text in "{([":
            depth += 1
        elif kind == "punct" and text in "})]":
            depth -= 1
        if kind == "name" and depth == 0 and text == "import" and text_at(i + 1) not in ("(", "."):
            i += 1
            typed = text_at(i) == "type" and text_at(i + 1) not in ("from", ",")
            i += typed
            names: list[tuple[str, str, bool]] = []
            if toks[i : i + 1] and toks[i][0] == "string":
                imported(toks[i][1][1:-1], "side-effect", offset, [])
                i += 1
                continue
            while i < len(toks) and text_at(i) != "from" and text_at(i) != ";":
                if text_at(i) == "{":
                    more, i = _list(toks, i, same)
                    names += more
                    continue
                if text_at(i) == "*":
                    names.append(("*", text_at(i + 2), False))
                    spaces[text_at(i + 2)] = nth
                    i += 3
                    continue
                if toks[i][0] == "name":
                    names.append(("default", text_at(i), False))
                i += 1
            if text_at(i) == "from" and i + 1 < len(toks):
                imported(toks[i + 1][1][1:-1], "static", offset, names, typed)
            i += 2
            lists.append((nth, i - 1))
            continue
        if kind == "name" and depth == 0 and text == "export":
            exporting = True
            i += 1
            typed = text_at(i) == "type" and text_at(i + 1) in ("{", "*")
            i += typed
            if text_at(i) == "*":
                alias = text_at(i + 2) if text_at(i + 1) == "as" else None
                i += 3 if alias else 1
                spec = toks[i + 1][1][1:-1] if text_at(i) == "from" and i + 1 < len(toks) else ""
                exported(alias or "*", offset, original="*", source=spec, target=target_of(path, spec), type_only=typed)
                i += 2
                lists.append((nth, i - 1))
            elif text_at(i) == "{":
                names, i = _list(toks, i, same)
                spec = toks[i + 1][1][1:-1] if text_at(i) == "from" and i + 1 < len(toks) else None
                for n, a, t in names:
                    exported(a, offset, original=n if spec is not None else None, source=spec, target=target_of(path, spec) if spec is not None else None, type_only=typed or t, local=n)
                i += 2 if spec is not None else 0
                lists.append((nth, i - 1))
            elif text_at(i) == "default":
                exported("default", offset, local=_default_name(code, i + 1))
                i += 1
            else:
                words = []
                while text_at(i) in _DECLARES:
                    words.append(text_at(i))
                    i += 1
                if text_at(i) == "*":
                    i += 1
                typed = bool(words) and words[-1] in ("interface", "type")
                if words and words[-1] in ("const", "let", "var"):
                    for n, k in _declared(code, i):
                        exported(n, toks[k][2], local=n)
                        named.add(k)
                elif toks[i : i + 1] and toks[i][0] == "name" and words:
                    exported(text_at(i), toks[i][2], type_only=typed, local=text_at(i))
                    named.add(i)
                if words and words[-1] in ("const", "let", "var"):
                    i -= 1  # the declaration is read on as any other
                    toks_kind = toks[i][0]
                    if toks_kind == "name" and text_at(i) == "const":
                        constant(i)
                    i += 1
            if i == nth:
                i += 1
            continue
        if kind == "name" and text_at(i + 1) == "(" and text in ("import", "require") and text_at(i - 1) != "." and i + 2 < len(toks):
            if is_string(i + 2) or toks[i + 2][0] == "template" and text_at(i + 2)[-1:] == "`":
                imported(toks[i + 2][1][1:-1], "dynamic" if text == "import" else "require", offset, [("*", "*", False)])
                if text == "require":
                    facts.smells.append({"kind": "commonjs", "detail": "require", "line": line(offset), "confidence": "high"})
            elif text == "import" and toks[i + 2][0] == "template" and text_at(i + 2).startswith(("`./", "`../")) and i + 1 in code.mate:
                parts, k = [], i + 2
                while k < code.mate[i + 1]:
                    if toks[k][0] == "template":
                        parts.append(re.sub(r"^[`}]|(?:`|\$\{)$", "", toks[k][1]))
                    k += 1
                globbed("*".join(parts), offset)
            if text == "import" and depth == 0 and i + 1 in code.mate:
                after = code.mate[i + 1] + 1
                if text_at(i - 1) == "await":
                    facts.smells.append({"kind": "lazy-import-top-level", "detail": "await", "line": line(offset), "confidence": "high"})
                elif text_at(after) == "." and text_at(after + 1) in ("then", "catch", "finally"):
                    facts.smells.append({"kind": "lazy-import-top-level", "detail": text_at(after + 1), "line": line(offset), "confidence": "medium"})
        if kind == "name" and text == "require" and text_at(i + 1) == "." and text_at(i - 1) != "." and text_at(i + 3) == "(" and is_string(i + 4):
            if text_at(i + 2) == "resolve":
                imported(toks[i + 4][1][1:-1], "dynamic", offset, [("*", "*", False)])
            elif text_at(i + 2) == "context" and toks[i + 4][1][1:].startswith("."):
                folder, deep, filter_ = toks[i + 4][1][1:-1].rstrip("/"), text_at(i + 6) == "true", text_at(i + 8) if text_at(i + 7) == "," else None
                end = re.fullmatch(r"/(?:\^?\\?\.\\?/)?(?:\.\*|\[\^/\]\*)?\\\.(\w+|\((?:\?:)?[\w|]+\)|\w+\?)\$/\w*", filter_ or "")
                if filter_ is None or end:
                    ext = end[1].strip("()").removeprefix("?:") if end else ""
                    ext = f"{ext[:-2]},{ext[:-1]}" if ext.endswith("?") else ext.replace("|", ",")
                    globbed(f"{folder}/{'**/' * deep}*" + (f".{{{ext}}}" if "," in ext else f".{ext}" if ext else ""), offset)
        if kind == "name" and text in ("vi", "jest") and [text_at(i + k) for k in (1, 2, 3)] == [".", "mock", "("] and is_string(i + 4):
            spec = toks[i + 4][1][1:-1]
            made = text_at(i + 5) == "," and text_at(i + 6) in ("(", "async", "function") or text_at(i + 7) == "=>"
            for s in (spec, None if made else mock_sibling(spec)):
                if s:
                    imported(s, "mock", offset, [("*", "*", False)])
        if kind == "name" and text == "import" and [text_at(i + k) for k in (1, 2, 3)] == [".", "meta", "."] and text_at(i + 4) in ("glob", "globEager"):
            k = i + 5
            while k < len(toks) and k < i + 60 and text_at(k) != "(":
                k += 1
            last = code.mate.get(k + 1, k + 1) if text_at(k + 1) == "[" else k + 1
            for j in range(k + 1, last + 1):
                if is_string(j):
                    globbed(toks[j][1][1:-1], offset)
        if kind == "name" and text == "new" and text_at(i + 1) == "URL" and text_at(i + 2) == "(" and is_string(i + 3) and [text_at(i + k) for k in range(4, 10)] == [",", "import", ".", "meta", ".", "url"]:
            imported(toks[i + 3][1][1:-1], "url", offset, [])
        if kind == "punct" and text == "@" and text_at(i + 1) == "Component" and text_at(i + 2) == "(" and i + 2 in code.mate:
            for k in range(i + 3, code.mate[i + 2]):
                if text_at(k) in ("templateUrl", "styleUrl", "styleUrls") and text_at(k + 1) == ":":
                    last = code.mate.get(k + 2, k + 2) if text_at(k + 2) == "[" else k + 2
                    for j in range(k + 2, last + 1):
                        if is_string(j):
                            url = toks[j][1][1:-1]
                            imported(url if url.startswith(".") else f"./{url}", "url", toks[j][2], [])
        if kind == "name" and text_at(i + 1) == "." and text_at(i + 3) == "=" and text_at(i + 4) != "=" and text_at(i - 1) != "." and (text == "module" and text_at(i + 2) == "exports" or text == "exports"):
            facts.smells.append({"kind": "commonjs", "detail": "module.exports" if text == "module" else "exports", "line": line(offset), "confidence": "high"})
        if kind == "name" and text in spaces and text_at(i - 1) != ".":
            skip = text_at(i + 1) == "?" and text_at(i + 2) == "."
            whole = text_at(i + 1) != "." and not skip
            facts.members.append({"object": text, "member": "*" if whole else text_at(i + 2 + skip)})
        if kind == "name" and depth == 0 and text == "const":
            constant(i)
        if kind == "name" and depth == 0 and text in ("const", "let", "var") and text_at(i + 2) == "=" and i + 3 < len(toks) and toks[i + 3][0] == "name" and text_at(i + 3) not in ("true", "false", "null", "undefined", "new", "await", "async", "function", "class", "typeof", "import", "this") and (text_at(i + 4) in (";", "") or code.breaks(i + 4)):
            if text_at(i - 1) != "export":
                facts.aliases.append({"name": text_at(i + 1), "source": text_at(i + 3), "line": line(offset)})
        if kind == "name" and text in ("function", "class", "interface", "type", "enum", "namespace", "const", "let", "var") and i + 1 < len(toks) and toks[i + 1][0] == "name" and text_at(i - 1) != ".":
            named.add(i + 1)
        if kind == "name" and not exporting:
            own.append(text)
        i += 1
    facts.references = set(own)
    facts.functions = shapes.complexity(code)
    facts.flags = list(shapes.flags(code, shapes.vercel_names(facts.imports)))
    facts.filenames = sorted(set(_FILENAME.findall(source)))
    known = {toks[k][1] for k in named} | {n["alias"] for x in facts.imports for n in x["names"]}
    facts.aliases = [a for a in facts.aliases if a["source"] in known]
    public = {e["local"] or e["name"] for e in facts.exports}
    facts.enum_members, facts.class_members = shapes.members(code, public)
    facts.uses = shapes.uses(code, sorted(lists), named)
    if any(k == "punct" and t in ")]}" and i not in code.mate for i, (k, t, _) in enumerate(toks)) or any(k == "punct" and t in "([{" and i not in code.mate for i, (k, t, _) in enumerate(toks)):
        facts.errors.append({"code": "parse-recovered", "line": 1})
    for detect in (patterns.expressions, patterns.functions, patterns.wrappers):
        facts.smells += detect(code)
    if re.search(r"\.[mc]?tsx?$", path):
        declared = list(patterns.types(code))
        facts.types = [{"name": n, "shape": shape, "line": at} for n, shape, at, _, _ in declared]
        facts.smells += patterns.assertions(code, path.endswith("x"))
        facts.smells += patterns.leaks(code, declared, public)
        facts.smells += shapes.redundant_types(code, declared)
        facts.inline_types = list(shapes.inline_types(code, declared))
    facts.smells += [{"kind": "redundant-alias", "detail": n, "line": line(o), "confidence": "high"} for n, o in same]
    facts.tokens = [(_BLIND.get(k, "I" if k == "name" and t not in _DECLARES and t not in ("return", "if", "for", "while", "import", "export", "from", "new", "await") else t), t, line(o)) for k, t, o in toks]
    return facts
