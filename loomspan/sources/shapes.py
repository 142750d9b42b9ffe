"""Facts of a file's tokens beyond its imports: complexity, flags, inline types, members, and where names are used."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from loomspan.sources import patterns
from loomspan.sources.patterns import Code

_CONTROL = frozenset("if for while switch catch with do".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare accessor".split())
_STATEMENT = frozenset("const let var function class interface type enum namespace import export return if for while do switch try throw break continue".split())
_OPERATORS = frozenset("= + - * / % , => ? : && || ?? . ( [ { | & < ! ~ ^ ...".split())

# Flag functions of providers, environment prefixes, and words of configuration objects.
SDK = {
    "LaunchDarkly": "useFlag useLDFlag useFeatureFlag variation boolVariation stringVariation numberVariation jsonVariation", "Statsig": "useGate checkGate useExperiment useConfig", "Unleash": "isEnabled getVariant", "GrowthBook": "isOn isOff getFeatureValue", "Split": "getTreatment",
    "PostHog": "useFeatureFlagEnabled useFeatureFlagPayload useFeatureFlagVariantKey getFeatureFlagPayload", "ConfigCat": "getValueAsync getValueDetailsAsync", "Flagsmith": "hasFeature", "Optimizely": "useDecision getFeatureVariable getFeatureVariableBoolean getFeatureVariableString getFeatureVariableInteger getFeatureVariableDouble getFeatureVariableJson getFeatureVariableJSON",
    "Eppo": "getStringAssignment getBooleanAssignment getNumericAssignment getIntegerAssignment getJSONAssignment",
}
_PROVIDER = {name: provider for provider, names in SDK.items() for name in names.split()}
_VERCEL = re.compile(r"(?:@vercel/)?flags(?:/|$)")
_CONFIG_WORDS = frozenset("feature features featureflags featureflag flag flags toggle toggles".split())
# Wrappers of which the parameters are looked into for inline types.
_WRAPPERS = frozenset("Array ReadonlyArray Promise Set ReadonlySet Map ReadonlyMap Record Partial Required Readonly NonNullable Awaited".split())
# Methods that frameworks call by name, and decorators that do.
LIFECYCLE = frozenset("render componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getSnapshotBeforeUpdate getDerivedStateFromProps getDerivedStateFromError componentDidCatch componentWillMount componentWillReceiveProps componentWillUpdate UNSAFE_componentWillMount UNSAFE_componentWillReceiveProps UNSAFE_componentWillUpdate getChildContext contextType ngOnInit ngOnDestroy ngOnChanges ngDoCheck ngAfterContentInit ngAfterContentChecked ngAfterViewInit ngAfterViewChecked ngAcceptInputType canActivate canDeactivate canActivateChild canMatch resolve intercept transform validate registerOnChange registerOnTouched writeValue setDisabledState".split())
DECORATORS = frozenset("Component Injectable NgModule Pipe Directive Controller Module Resolver Query Mutation Get Post Put Patch Delete Head Options All Sse WebSocketGateway SubscribeMessage".split())


def _ends(code: Code, i: int) -> bool:
    """Does a statement without a semicolon end before token i?"""
    return code.breaks(i) and code.at(i - 1) not in _OPERATORS and (code.is_name(i) or code.at(i) in ("@", "}", "{"))


def statement_end(code: Code, i: int) -> int:
    """The last token of the statement that begins at token i."""
    text = code.at(i)
    if text == "{" and i in code.mate:
        return code.mate[i]
    if text in ("if", "for", "while", "switch", "with", "catch") and code.is_name(i):
        k = i + 1 + (code.at(i + 1) == "await")
        k = code.mate.get(k, k) + 1 if code.at(k) == "(" else k
        end = statement_end(code, k) if k < len(code.toks) else len(code.toks) - 1
        if text == "if":
            after = end + 1 + (code.at(end + 1) == ";")
            if code.at(after) == "else" and code.is_name(after):
                return statement_end(code, after + 1)
        return end
    if text == "do" and code.is_name(i):
        end = statement_end(code, i + 1)
        if code.at(end + 1) == "while" and code.at(end + 2) == "(":
            return code.mate.get(end + 2, end + 2)
        return end
    k = i
    while k < len(code.toks):
        if code.at(k) == ";":
            return k
        if code.toks[k][0] == "punct" and code.at(k) in (")", "]", "}"):
            return k - 1
        if k > i and _ends(code, k):
            return k - 1
        k = code.mate[k] + 1 if code.toks[k][0] == "punct" and code.at(k) in ("(", "[", "{") and k in code.mate and code.mate[k] > k else k + 1
    return len(code.toks) - 1


def _body_after(code: Code, close: int) -> int | None:
    """The brace of a body after a parameter list that ends at `close`; a type of result may lie between."""
    k = close + 1
    if code.at(k) == "{":
        return k
    if code.at(k) != ":":
        return None
    k += 1
    while k < len(code.toks) and k < close + 200:
        if code.at(k) == "{" and code.at(k - 1) not in (":", "|", "&", "<", "=>", ",", "is"):
            return k
        if code.at(k) in (";", "=", ")") or code.at(k) == "=>" and code.at(close + 1) != ":":
            return None
        k = code.mate[k] + 1 if code.toks[k][0] == "punct" and code.at(k) in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1
    return None


def _functions(code: Code) -> Iterator[tuple[str, int, int, int, int]]:
    """Name, first token, first and last token of the body, number of parameters."""

    def count(opens: int) -> int:
        n, part, k, angle = 0, False, opens + 1, 0
        while k < code.mate[opens]:
            t = code.at(k)
            angle += (t == "<") - (t == ">")
            if t == "," and not angle:
                n, part = n + part, False
            else:
                part = True
            k = code.mate[k] + 1 if code.toks[k][0] == "punct" and t in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1
        return n + part

    for i, (kind, text, _) in enumerate(code.toks):
        if kind == "name" and text == "function" and code.at(i - 1) != ".":
            k = i + 1 + (code.at(i + 1) == "*")
            name = code.at(k) if code.is_name(k) else None
            while k < len(code.toks) and k < i + 40 and code.at(k) != "(":
                k += 1
            if k in code.mate and (brace := _body_after(code, code.mate[k])) is not None and brace in code.mate:
                back = i - 1 - (code.at(i - 1) == "async")
                name = name or (code.at(back - 1) if code.at(back) == "=" and code.is_name(back - 1) else "<anonymous>")
                yield name, i, brace, code.mate[brace], count(k)
        elif kind == "punct" and text == "=>":
            start = code.params(i)
            if start is None:
                continue
            n = count(start) if code.at(start) == "(" and code.mate.get(start, -1) > start else 1
            back = start - 1 - (code.at(start - 1) == "async")
            if code.at(back) == ">":  # type parameters
                while back > 0 and code.at(back) != "<":
                    back -= 1
                back -= 1
            name = "<arrow>"
            if code.at(back) == "=":
                k = back - 1
                while k > 0 and code.at(k) not in ("const", "let", "var", ";", "{", "}", ",") and k > back - 40:
                    k -= 1
                name = code.at(k + 1) if code.is_name(k + 1) else name
                name = code.at(back - 1) if code.is_name(back - 1) and name == "<arrow>" else name
            if code.at(i + 1) == "{" and i + 1 in code.mate:
                yield name, start, i + 1, code.mate[i + 1], n
            else:
                yield name, start, i + 1, _expression_end(code, i + 1), n
        elif kind == "punct" and text == "(" and code.mate.get(i, 0) > i:
            at = _before_generics(code, i - 1)
            if not code.is_name(at) or code.at(at) in _CONTROL | {"function", "return", "super", "new", "await", "typeof"}:
                continue
            before = code.at(at - 1)
            if before == ")" and code.toks[at - 1][0] == "punct" and (opens := code.mate.get(at - 1)) is not None and code.at(code.dotted_to(opens)[1] - 1) == "@":
                before = ";"  # a decorator
            if before in ("{", "}", ";", ",", "*") or before in _MODIFIERS or code.breaks(at) and before not in _OPERATORS:
                brace = _body_after(code, code.mate[i])
                if brace is not None and brace in code.mate:
                    yield code.at(at), at, brace, code.mate[brace], count(i)


def _before_generics(code: Code, i: int) -> int:
    """The token before the type parameters that end at token i, or i if none do."""
    if code.at(i) != ">" or code.toks[i][0] != "punct":
        return i
    depth = 0
    for k in range(i, max(-1, i - 60), -1):
        depth += (code.at(k) == ">") - (code.at(k) == "<")
        if not depth:
            return k - 1
    return i


def _expression_end(code: Code, k: int) -> int:
    start = k
    while k < len(code.toks):
        if code.toks[k][0] == "punct" and code.at(k) in (",", ";", ")", "]", "}"):
            return k - 1
        if k > start and _ends(code, k):
            return k - 1
        k = code.mate[k] + 1 if code.toks[k][0] == "punct" and code.at(k) in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1
    return len(code.toks) - 1


def complexity(code: Code) -> list[dict]:
    """Of each function its decisions, their weight by nesting, lines and parameters. What an inner function holds counts for that one only."""
    found = sorted(_functions(code), key=lambda f: (f[2], -f[3]))
    owner, out, open_ = [-1] * len(code.toks), [], []
    for nth, (_, _, first, last, _) in enumerate(found):
        open_.append((first, last, nth))
        for k in range(first, min(last, len(owner) - 1) + 1):
            owner[k] = nth  # inner ones come later
    state = [{"cyclomatic": 1, "cognitive": 0, "operator": None, "ends": []} for _ in found]
    for k, (kind, text, _) in enumerate(code.toks):
        if owner[k] < 0:
            continue
        s = state[owner[k]]
        while s["ends"] and s["ends"][-1][0] < k:
            if s["ends"].pop()[1]:
                s["operator"] = None
        nested = len(s["ends"])
        if kind == "name" and text in ("if", "for", "while", "do", "catch") and code.at(k - 1) != "." and code.at(k + 1) != ":":
            if text == "while" and code.at(k - 1) in ("}", ";") and _of_do(code, k):
                continue
            s["cyclomatic"] += 1
            s["cognitive"] += 1 + nested
            s["ends"].append((statement_end(code, k), text == "if"))
        elif kind == "name" and text == "case" and code.at(k - 1) != ".":
            s["cyclomatic"] += 1
            s["cognitive"] += 1
        elif kind == "punct" and text in ("&&", "||", "??"):
            s["cyclomatic"] += 1
            if code.at(k + 1) != "=" and s["operator"] != text:
                s["cognitive"] += 1
                s["operator"] = text
        elif kind == "punct" and text == "?":
            if code.at(k + 1) == ".":
                s["cyclomatic"] += not _chained(code, k)
            elif code.at(k + 1) not in (":", ")", ",", "=", ";", "?") and _ternary(code, k):
                s["cyclomatic"] += 1
                s["cognitive"] += 1 + nested
    for (name, start, _, last, n), s in zip(found, state, strict=True):
        line = code.line(code.toks[start][2])
        out.append({"name": name, "line": line, "cyclomatic": s["cyclomatic"], "cognitive": s["cognitive"], "lines": max(1, code.line(code.toks[min(last, len(code.toks) - 1)][2]) - line + 1), "params": n})
    return sorted(out, key=lambda f: f["line"])


def _of_do(code: Code, k: int) -> bool:
    start = code.mate.get(k - 1 - (code.at(k - 1) == ";"))
    return start is not None and code.at(start - 1) == "do"


def _chained(code: Code, k: int) -> bool:
    """Is there an optional access before this one in the same chain?"""
    i = k - 1
    while i > 0:
        if code.at(i) in (")", "]") and code.toks[i][0] == "punct":
            i = code.mate.get(i, 0) - 1
        elif code.is_name(i):
            i -= 1
        else:
            return False
        if code.at(i) == ".":
            if code.at(i - 1) == "?":
                return True
            i -= 1
        elif not (code.at(i) in (")", "]") or code.is_name(i) and code.at(i + 1) in ("(", "[")):
            return False
    return False


def _ternary(code: Code, k: int) -> bool:
    """Does a colon follow at the same depth, as in a choice between values, and no type condition come before?"""
    i = k + 1
    while i < len(code.toks):
        t = code.at(i)
        if code.toks[i][0] == "punct" and t in (")", "]", "}", ";"):
            return False
        if t == ":":
            return not code.conditional_type(k)
        i = code.mate[i] + 1 if code.toks[i][0] == "punct" and t in ("(", "[", "{") and code.mate.get(i, 0) > i else i + 1
    return False


def flags(code: Code, vercel: set[str], config_objects: bool = True) -> Iterator[dict]:
    """Feature flags: environment names, calls of flag functions, and members of configuration objects, with the test that guards them.

    A flag is guarded by an `if` or a choice whose test it stands in; one in a branch has the guard around that.
    """
    guards = []
    for i, (kind, text, _) in enumerate(code.toks):
        if kind == "name" and text == "if" and code.at(i + 1) == "(" and i + 1 in code.mate:
            guards.append((i + 1, code.mate[i + 1], code.line(code.toks[i][2]), code.line(code.toks[min(statement_end(code, i), len(code.toks) - 1)][2])))
        elif kind == "punct" and text == "?" and code.at(i + 1) not in (".", "?", ":") and _ternary(code, i):
            start = i
            for start in code.back(i):  # noqa: B007
                if code.at(start) in ("=", "return", "=>", ",", ";", "(", "{", "&&", "||", "??") and code.toks[start][0] != "string":
                    break
            end = _expression_end(code, i + 1)
            guards.append((start, i, code.line(code.toks[min(start + 1, i)][2]), code.line(code.toks[min(end, len(code.toks) - 1)][2])))

    def row(i: int, name: str, kind: str, provider: str | None) -> dict:
        inner = [g for g in guards if g[0] <= i <= g[1]]
        guard = min(inner, key=lambda g: g[1] - g[0]) if inner else (0, 0, None, None)
        return {"name": name, "kind": kind, "provider": provider, "line": code.line(code.toks[i][2]), "guard_start": guard[2], "guard_end": guard[3]}

    for i, (kind, text, _) in enumerate(code.toks):
        if kind != "name":
            continue
        if text == "process" and code.at(i + 1) == "." and code.at(i + 2) == "env":
            if code.at(i + 3) == "." and code.is_name(i + 4):
                yield row(i, code.at(i + 4), "env-var", None)
            elif code.at(i + 3) == "[" and code.at(i + 5) == "]" and code.toks[i + 4][0] == "string":
                yield row(i, code.at(i + 4)[1:-1], "env-var", None)
        elif code.at(i + 1) == "(" and (text in _PROVIDER or text in vercel) and code.at(i - 1) != "function":
            member = code.at(i - 1) == "."
            if member and (text in vercel or code.at(i - 3) == "."):
                continue
            name = _string_argument(code, i + 1)
            if name is not None:
                yield row(i, name, "sdk-call", "Vercel Flags" if text in vercel else _PROVIDER[text])
        elif config_objects and code.at(i + 1) == "." and code.is_name(i + 2) and code.at(i - 1) != "." and (text.lower() in _CONFIG_WORDS or code.at(i + 2).lower() in _CONFIG_WORDS):
            yield row(i, f"{text}.{code.at(i + 2)}", "config-object", None)


def _string_argument(code: Code, opens: int) -> str | None:
    if code.at(opens + 1)[:1] in ("'", '"') and code.toks[opens + 1][0] == "string":
        return code.at(opens + 1)[1:-1]
    if code.at(opens + 1) == "{":
        for k in range(opens + 2, code.mate.get(opens + 1, opens + 2)):
            if code.at(k).strip("\"'") in ("key", "name") and code.at(k + 1) == ":":
                return code.at(k + 2).strip("\"'")
    return None


def vercel_names(imports: list[dict]) -> set[str]:
    return {n["alias"] for i in imports if _VERCEL.match(i["specifier"]) for n in i["names"] if n["name"] in ("flag", "evaluate")}


def _members(code: Code, brace: int) -> list[tuple[int, int]]:
    """First and last tokens of the members of a type's braces."""
    out, first, k, end = [], brace + 1, brace + 1, code.mate[brace]
    while k <= end:
        if k == end or code.at(k) in (";", ",") or k > first and code.breaks(k) and code.at(k) not in ("|", "&") and code.at(k - 1) not in ("|", "&", ":", "="):
            if k > first:
                out.append((first, k - 1))
            first = k + (code.at(k) in (";", ",") or k == end)
        k = code.mate[k] + 1 if k < end and code.toks[k][0] == "punct" and code.at(k) in ("(", "[", "{") and code.mate.get(k, 0) > k else k + 1
    return out


def _is_property(code: Code, first: int, last: int) -> bool:
    k = first + (code.at(first) == "readonly" and code.at(first + 1) not in (":", "?"))
    return (code.is_name(k) or code.toks[k][0] == "string") and code.at(k + 1 + (code.at(k + 1) == "?")) == ":" and k + 1 < last


def inline_types(code: Code, declared: list[tuple[str, str, int, int, int]]) -> Iterator[dict]:
    """Object types of three properties or more written where they are used: in parameters, results, variables and properties."""
    interfaces = [(start, end) for _, _, _, start, end in declared]
    functions = [(start, first) for _, start, first, _, _ in _functions(code)]
    for i, (kind, text, _) in enumerate(code.toks):
        if kind != "punct" or text != "{" or code.mate.get(i, -1) < i:
            continue
        k, wrapped = i - 1, False
        while code.at(k) in ("<", "|", "&", ",", "(") and k > 0:
            if code.at(k) == "<":
                if code.at(k - 1) not in _WRAPPERS:
                    break
                k -= 2
                wrapped = True
            elif code.at(k) in ("|", "&") or code.at(k) == "," and wrapped:
                k = _operand_start(code, k)
            else:
                break
        if code.at(k) != ":":
            continue
        name = code.at(k - 1) if code.is_name(k - 1) else code.at(k - 2) if code.at(k - 1) == "?" and code.is_name(k - 2) else None
        members = _members(code, i)
        if not members or not all(_is_property(code, *m) for m in members) or len(members) < 3:
            continue
        separated = all(code.at(last + 1) != "," for _, last in members)
        within = next(((a, b) for a, b in interfaces if a <= i <= b), None)
        params = next(((a, b) for a, b in functions if a <= i < b), None)
        if within:
            context = "interface-property"
        elif params and code.at(k - 1) == ")":
            context = "function-return"
        elif params:
            context = "function-parameter"
        elif name and code.at(k - 2) in ("const", "let", "var"):
            context = "variable-annotation"
        elif separated and name and code.at(code.mate[i] + 1) in (";", "=") and code.at(k - 2) in (";", "{", "}", *_MODIFIERS):
            context = "class-property"
        else:
            continue
        keys = sorted(code.at(a + (code.at(a) == "readonly" and code.at(a + 1) not in (":", "?"))).strip("\"'") for a, _ in members)
        preview = "{ " + ", ".join(keys[:4]) + (f", +{len(keys) - 4} more" if len(keys) > 4 else "") + " }"
        shape = hashlib.sha256(patterns._shape(code, i, code.mate[i]).encode()).hexdigest()
        yield {"shape": shape, "members": len(members), "preview": preview, "context": context, "name": name, "line": code.line(code.toks[i][2])}


def _operand_start(code: Code, k: int) -> int:
    """The token before the operand that ends before token k."""
    k -= 1
    while k > 0 and code.at(k) not in (":", "|", "&", "<", ",", "=", "("):
        k = code.mate[k] - 1 if code.toks[k][0] == "punct" and code.at(k) in (")", "]", "}") and k in code.mate else k - 1
    return k


def redundant_types(code: Code, declared: list[tuple[str, str, int, int, int]]) -> Iterator[dict]:
    """Types that a simpler one equals: of each declaration the first kind that fits."""
    for name, _, line, start, end in declared:
        if code.at(start - 2) == "interface":
            brace = next((k for k in range(start, end + 1) if code.at(k) == "{"), end)
            head = [code.at(k) for k in range(start, brace)]
            if code.mate.get(brace) == brace + 1 and "extends" in head:
                parent = head[head.index("extends") + 1 :]
                if "," not in _outside(parent) and parent[-2:] not in ([".", "infer"], [".", "Props"]):
                    yield {"kind": "redundant-type-pattern", "detail": f"{name}:empty-interface-extends-one", "line": line, "confidence": "high"}
            continue
        k = next((k for k in range(start, end + 1) if code.at(k) == "="), None)
        if k is None:
            continue
        body = [code.at(j) for j in range(k + 1, end + 1)]
        body = body[1:] if body[:1] in (["|"], ["&"]) else body
        union, both = _split(body, "|"), _split(body, "&")
        found = None
        if len(union) == 1 and len(both) > 1 and ["{", "}"] in both:
            found = "intersection-with-empty-object"
        elif len(union) > 1 and len({" ".join(u) for u in union}) < len(union):
            found = "self-union"
        elif len(union) == 1 and len(both) > 1 and len({" ".join(u) for u in both}) < len(both):
            found = "self-intersection"
        elif len(body) > 4 and body[0] == body[2] and body[1] == body[3] == "<" and body[-2:] == [">", ">"] and body[0] in ("Partial", "Readonly", "Required"):
            found = f"nested-{body[0].lower()}"
        elif len(body) == 7 and body[0] == "Pick" and body[1] == "<" and body[3:5] == [",", "keyof"] and body[2] == body[5]:
            found = "pick-all-keys"
        elif len(body) == 6 and body[0] == "Omit" and body[1] == "<" and body[3:5] == [",", "never"]:
            found = "omit-no-keys"
        if found:
            yield {"kind": "redundant-type-pattern", "detail": f"{name}:{found}", "line": line, "confidence": "high"}


def _outside(words: list[str]) -> list[str]:
    out, depth = [], 0
    for w in words:
        depth += (w in "<([{") - (w in ">)]}") if len(w) == 1 else 0
        if not depth:
            out.append(w)
    return out


def _split(words: list[str], by: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    depth = 0
    for w in words:
        depth += (w in "<([{") - (w in ">)]}") if len(w) == 1 else 0
        if w == by and depth == 0:
            out.append([])
        else:
            out[-1].append(w)
    return out


def members(code: Code, exported: set[str]) -> tuple[list[dict], list[dict]]:
    """Members of enums and of classes at the top of a file."""
    enums, classes, depth = [], [], 0
    for i, (kind, text, _) in enumerate(code.toks):
        if kind == "punct":
            depth += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
        if depth or kind != "name" or not code.is_name(i + 1):
            continue
        if text == "enum" and code.at(i + 2) == "{" and i + 2 in code.mate:
            name, strings, rows = code.at(i + 1), True, []
            for a, b in _members(code, i + 2):
                strings &= code.at(a + 1) == "=" and code.toks[b][0] == "string" and b == a + 2
                rows.append((code.at(a).strip("\"'"), code.line(code.toks[a][2])))
            kind_of = "const" if code.at(i - 1) == "const" else "string" if strings and rows else "mixed"
            enums += [{"owner": name, "member": m, "kind": kind_of, "line": at, "exported": name in exported} for m, at in rows]
        elif text == "class":
            brace = i + 2
            while brace < len(code.toks) and code.at(brace) != "{":
                brace += 1
            if brace not in code.mate:
                continue
            head = [code.at(k) for k in range(i + 2, brace)]
            base = head[head.index("extends") + 1] if "extends" in head[:-1] else None
            classes += _class_members(code, code.at(i + 1), base, brace, code.at(i + 1) in exported)
    return enums, classes


def _class_members(code: Code, owner: str, base: str | None, brace: int, exported: bool) -> Iterator[dict]:
    k, end = brace + 1, code.mate[brace]
    while k < end:
        words, decorated = [], False
        while k < end and (code.at(k) == "@" or code.at(k) in _MODIFIERS and code.at(k + 1) not in ("(", "=", ":", ";", "?", "!", "<") or code.at(k) in ("*", ";")):
            if code.at(k) == "@":
                name, after = code.dotted_from(k + 1)
                decorated |= name.rpartition(".")[2] in DECORATORS
                k = code.mate[after] + 1 if code.at(after) == "(" and after in code.mate else after
                continue
            words.append(code.at(k))
            k += 1
        if k >= end:
            return
        start = k
        name = code.at(k)
        plain = code.is_name(k)
        private = name == "#" or "private" in words
        k += 1 + (name == "#")
        while k < end and code.at(k) in ("?", "!"):
            k += 1
        if code.at(k) == "<":
            while k < end and code.at(k) != "(":
                k += 1
        if code.at(k) == "(" and k in code.mate:
            body = _body_after(code, code.mate[k])
            kind = "accessor" if "get" in words or "set" in words else "method"
            k = code.mate[body] + 1 if body is not None and body in code.mate else statement_end(code, k) + 1
        else:
            kind, k = "property", max(statement_end(code, start), start) + 1
        if plain and name != "constructor" and not private:
            yield {"owner": owner, "base": base, "member": name, "kind": kind, "line": code.line(code.toks[start][2]), "exported": exported, "skipped": decorated or name in LIFECYCLE}


def uses(code: Code, spans: list[tuple[int, int]], declared: set[int]) -> list[dict]:
    """How often each name, and each member of a name, is used outside of import and export lists and its own declaration.

    The member is `*` for a use of the whole as a value, `[` for one by a computed key, and empty in a type.
    """
    found: Counter[tuple[str, str]] = Counter()
    starts = [a for a, _ in spans]
    for i, (kind, text, _) in enumerate(code.toks):
        if kind != "name":
            continue
        at = bisect_right(starts, i) - 1
        if i in declared or at >= 0 and i <= spans[at][1]:
            continue
        if code.at(i - 1) == ".":
            found[("", text)] += 1
            continue
        if code.at(i + 1) == "." or code.at(i + 1) == "?" and code.at(i + 2) == ".":
            k = i + 2 + (code.at(i + 1) == "?")
            found[(text, code.at(k))] += 1
        elif code.at(i + 1) == "[" and not code.breaks(i + 1):
            found[(text, "[")] += 1
        elif code.at(i - 1) in ("<", "as", "extends", "implements", "keyof", "typeof", "is", "satisfies") or code.at(i - 1) == ":" and _annotates(code, i - 1):
            found[(text, "")] += 1
        elif code.at(i + 1) == ":" and code.at(i - 1) in ("{", ","):
            continue  # a key
        else:
            found[(text, "*")] += 1
    return [{"name": n, "member": m, "n": k} for (n, m), k in sorted(found.items())]


def _annotates(code: Code, colon: int) -> bool:
    """Is a colon one of a type: after a parameter, a variable, or a parameter list?"""
    before = colon - 1 - (code.at(colon - 1) == "?")
    if code.at(before) == ")":
        return True
    if not code.is_name(before):
        return False
    if code.at(before - 1) in ("const", "let", "var", *_MODIFIERS):
        return True
    for k in code.back(before, 60):
        if code.at(k) == "?":
            return False
    opens = before
    for k in code.back(before, 200):
        opens = k
    around = opens - 1 if opens > 0 else 0
    return code.at(around) == "(" or code.at(before - 1) == ";"
