"""Patterns in the tokens of a file that a shorter or safer form could replace, and the shapes of its types.

All work on the scanner's tokens with a table of matching brackets; no syntax tree is built. What
they cannot tell apart from tokens alone they leave out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

Token = tuple[str, str, int]
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
#: Tokens after which an expression begins, and those after which it has ended for certain.
_BEGINS = frozenset(("", "=", "(", ",", "[", "{", "}", "return", "=>", "?", ":", ";"))
_ENDS = frozenset(("", ")", "]", "}", ",", ";", ":"))
_CONTROL = frozenset("if for while switch catch with".split())
_BINDS = frozenset(("const", "let", "var"))


class Code:
    """Tokens with their matching brackets."""

    def __init__(self, toks: list[Token], line: Callable[[int], int]) -> None:
        self.toks, self.line = toks, line
        self.mate, stack = {}, []
        for i, (kind, text, _) in enumerate(toks):
            if kind != "punct":
                continue
            if text in _OPEN:
                stack.append(i)
            elif text in _CLOSE and stack:
                self.mate[i] = stack[-1]
                self.mate[stack.pop()] = i

    def at(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i][0] == "name"

    def breaks(self, i: int) -> bool:
        """Does a new line begin at token i?"""
        return i >= len(self.toks) or i > 0 and self.line(self.toks[i - 1][2] + len(self.toks[i - 1][1]) - 1) < self.line(self.toks[i][2])

    def ended(self, i: int) -> bool:
        """Has an expression ended before token i?"""
        return self.at(i) in _ENDS or self.breaks(i) and self.toks[i][0] == "name"

    def dotted_to(self, i: int) -> tuple[str, int]:
        """The dotted name that ends before token i, and where it begins."""
        k = i - 1
        if not self.is_name(k):
            return "", i
        while self.at(k - 1) == "." and self.is_name(k - 2):
            k -= 2
        return "".join(self.at(j) for j in range(k, i)), k

    def dotted_from(self, i: int) -> tuple[str, int]:
        """The dotted name that begins at token i, and the place after it."""
        if not self.is_name(i):
            return "", i
        k = i + 1
        while self.at(k) == "." and self.is_name(k + 1):
            k += 2
        return "".join(self.at(j) for j in range(i, k)), k

    def back(self, i: int, most: int = 200) -> Iterator[int]:
        """Tokens before i at its own depth, nearest first, up to the bracket around it."""
        k = i - 1
        for _ in range(most):
            if k < 0 or self.toks[k][0] == "punct" and self.at(k) in _OPEN:
                return
            yield k
            k = self.mate.get(k, k) - 1 if self.at(k) in _CLOSE else k - 1

    def conditional_type(self, i: int) -> bool:
        """Does the `?` at token i belong to a type that extends another?"""
        for k in self.back(i, len(self.toks)):
            if self.at(k) == "extends":
                return True
            if self.at(k) in ("=", "=>", ";", ",", "return", "}") or self.breaks(k + 1) and self.at(k) not in ("|", "&"):
                return False
        return False

    def params(self, i: int) -> int | None:
        """Where the parameter list that ends before token i begins; a type of result may lie between."""
        if self.at(i - 1) == ")":
            return self.mate.get(i - 1)
        if self.is_name(i - 1) and self.at(i - 2) == ":" and self.at(i - 3) == ")":
            return self.mate.get(i - 3)
        if self.is_name(i - 1) and (self.at(i - 2) in _BEGINS or self.at(i - 2) == "async"):
            return i - 1
        for k in self.back(i, 40):
            if self.at(k) == ":" and self.at(k - 1) == ")":
                return self.mate.get(k - 1)
            if self.at(k) in (";", "=", "=>", ","):
                return None
        return None

    def of_function(self, brace: int) -> bool:
        """Is the block at `brace` a function's?"""
        if self.at(brace - 1) == "=>":
            return True
        start = self.params(brace)
        return start is not None and self.at(start) == "(" and self.at(start - 1) not in _CONTROL


def _row(kind: str, detail: str, code: Code, i: int, confidence: str) -> dict:
    return {"kind": kind, "detail": detail, "line": code.line(code.toks[i][2]), "confidence": confidence}


def expressions(code: Code) -> Iterator[dict]:
    """Ternaries that give their test or a boolean, double negation, `?? null`, and two checks that one does."""
    for i, (kind, text, _) in enumerate(code.toks):
        if kind != "punct":
            continue
        if text == "?" and code.at(i + 1) in ("true", "false") and code.at(i + 2) == ":" and {code.at(i + 1), code.at(i + 3)} == {"true", "false"} and code.ended(i + 4):
            if not code.conditional_type(i):
                yield _row("simplifiable-expression", "ternary-returns-boolean", code, i, "high")
        elif text == "?":
            test, start = code.dotted_to(i)
            then, end = code.dotted_from(i + 1)
            if test and test == then and code.at(end) == ":" and code.at(start - 1) in _BEGINS:
                yield _row("simplifiable-expression", "self-fallback-ternary", code, start, "medium")
        elif text == "!" and code.at(i + 1) == "!" and code.at(i - 1) != "!" and not _value(code, i - 1):
            yield _row("simplifiable-expression", "double-bang-boolean", code, i, "high")
        elif text == "??" and code.at(i + 1) in ("null", "undefined") and code.ended(i + 2):
            yield _row("simplifiable-expression", "nullish-coalescing-with-nullish", code, i, "medium")
        elif text == "&&" and code.at(i - 2) == "!==" and {code.at(i - 1), "null", "undefined"} == {"null", "undefined"}:
            left, start = code.dotted_to(i - 2)
            right, end = code.dotted_from(i + 1)
            if left and left == right and code.at(end) == "!==" and {code.at(i - 1), code.at(end + 1)} == {"null", "undefined"} and (code.at(start - 1) in _BEGINS or code.at(start - 1) == "||"):
                yield _row("simplifiable-expression", "redundant-null-and-undefined-check", code, start, "high")


def _value(code: Code, i: int) -> bool:
    """Does token i end a value?"""
    if not 0 <= i < len(code.toks):
        return False
    kind, text, _ = code.toks[i]
    return kind in ("string", "template", "number") or text in (")", "]") or kind == "name" and text not in ("return", "typeof", "case", "in", "of", "await", "yield", "delete", "void", "new", "else")


def functions(code: Code) -> Iterator[dict]:
    """Blocks of a lone return, an awaited value returned under a name, and async without a use for it."""
    for i, (kind, text, _) in enumerate(code.toks):
        if text == "=>" and kind == "punct" and code.at(i + 1) == "{" and code.at(i + 2) == "return" and i + 1 in code.mate:
            end, start = code.mate[i + 1], code.params(i)
            inner = range(i + 3, end - (code.at(end - 1) == ";"))
            first = next((k for k in inner if code.at(k) != "("), end)
            alone = len(inner) > 0 and not any(code.at(k) == ";" for k in code.back(inner.stop, len(code.toks)))
            if start is not None and code.at(start - 1) != "async" and alone and code.at(first) not in ("{", "<"):
                yield _row("simplifiable-function", "block-arrow-single-return", code, start, "high")
        elif text == "return" and kind == "name" and code.is_name(i + 1):
            end = i + 2 + (code.at(i + 2) == ";")
            if code.at(end) == "}" and end in code.mate and code.of_function(code.mate[end]):
                start = next((k for k in code.back(i - (code.at(i - 1) == ";")) if code.at(k) in _BINDS or code.at(k) in (";", ",")), None)
                if start is not None and code.at(start) in _BINDS and code.at(start + 1) == code.at(i + 1):
                    put = next((k for k in range(start + 2, i) if code.at(k) == "="), i)
                    if code.at(put + 1) == "await" and (put == start + 2 or code.at(start + 2) == ":") and not any(code.at(k) == "return" for k in range(put, i)):
                        yield _row("simplifiable-function", "redundant-await-return", code, start, "high")
        elif text == "async" and kind == "name" and code.at(i - 1) not in ("(", ",", ":", "."):
            found = _async(code, i)
            if found:
                yield found


def _async(code: Code, i: int) -> dict | None:
    """A function declared async at token i, whose body has no await, call or promise and whose result has no type Promise."""
    k = i + 1
    if code.at(k) == "function":
        while k < len(code.toks) and code.at(k) != "(":
            k += 1
    elif code.at(k) != "(" and not (code.is_name(k) and code.at(k + 1) == "=>"):
        return None
    close = code.mate.get(k, k)
    body = close + 1
    while body < len(code.toks) and code.at(body) not in ("{", "=>", ";"):
        body += 1
    if code.at(i + 1) != "function" and code.at(body) != "=>":
        return None
    if any(code.at(j) == "Promise" for j in range(close, body)):
        return None
    body += code.at(body) == "=>"
    end = code.mate.get(body) if code.at(body) == "{" else next((j for j in range(body, len(code.toks)) if code.at(j) in (";", ",") or code.breaks(j + 1)), None)
    if end is None:
        return None
    for j in range(body, end + 1):
        if code.at(j) in ("await", "Promise", "yield", "new", "import") or code.at(j) == "(" and (code.at(j - 1) in (")", "]") or code.is_name(j - 1) and code.at(j - 1) not in _CONTROL | {"return"}):
            return None
    return _row("simplifiable-function", "useless-async-no-await", code, i, "low")


def wrappers(code: Code) -> Iterator[dict]:
    """Variables that hold a function which passes its own parameters on, as they come, to another."""
    for i, (kind, text, _) in enumerate(code.toks):
        if text not in _BINDS or kind != "name" or not code.is_name(i + 1):
            continue
        k = i + 2
        if code.at(k) != "=":
            continue
        k += 1 + (code.at(k + 1) == "function")
        plain = code.at(k - 1) == "function"
        if plain and code.is_name(k):
            k += 1
        if code.at(k) == "(" and k in code.mate:
            names, after = _names(code, k), code.mate[k] + 1
        elif code.is_name(k) and code.at(k) != "async" and not plain:
            names, after = [code.at(k)], k + 1
        else:
            continue
        while after < len(code.toks) and code.at(after) not in ("=>", "{", ";", "="):
            after += 1
        if names is None or code.at(after) != ("{" if plain else "=>"):
            continue
        body = after if plain else after + 1
        if code.at(body) == "{":
            last = code.mate.get(body, -1)
            body += 2
            if code.at(body - 1) != "return":
                continue
        else:
            last = -1
        callee, call = code.dotted_from(body)
        if not callee or callee == code.at(i + 1) or code.at(call) != "(" or call not in code.mate:
            continue
        end = code.mate[call]
        given = [code.at(j) for j in range(call + 1, end) if code.at(j) != ","]
        wanted = [x for n in names for x in (("...", n[3:]) if n.startswith("...") else (n,))]
        closed = last in (end + 1, end + 2) and code.at(end + 1) in (";", "}") if last >= 0 else code.ended(end + 1)
        if given == wanted and closed and (len(names) == 1 or not any(n.startswith("...") for n in names)):
            yield _row("identity-wrapper", f"{code.at(i + 1)} -> {callee}", code, i + 1, "high")


def _names(code: Code, start: int) -> list[str] | None:
    """Names of a parameter list; null if one has a default or is taken apart."""
    names, k, end = [], start + 1, code.mate[start]
    while k < end:
        rest = code.at(k) == "..."
        k += rest
        if not code.is_name(k):
            return None
        names.append("..." * rest + code.at(k))
        angle = 0
        while k < end and (code.at(k) != "," or angle):
            if code.at(k) == "=":
                return None
            angle += (code.at(k) == "<") - (code.at(k) == ">")
            k = code.mate[k] + 1 if code.at(k) in _OPEN and k in code.mate else k + 1
        k += 1
    return names


def assertions(code: Code, tsx: bool) -> Iterator[dict]:
    """Type assertions that do nothing or give the type up. For TypeScript."""
    for i, (kind, text, _) in enumerate(code.toks):
        if text == "as" and kind == "name" and _value_or_brace(code, i - 1) and code.at(i + 1) in ("any", "unknown"):
            j = i + 2
            j += code.at(j) == ")"
            if code.at(j) == "as" and code.at(j + 1) not in ("any", "unknown", "const"):
                yield _row("unnecessary-assertion", "redundant-double-assertion", code, i, "high")
            if code.at(i + 1) == "any" and code.at(i + 2) != "[":
                yield _row("unnecessary-assertion", "assertion-to-any", code, i, "medium")
        elif text == "!" and kind == "punct" and code.at(i + 1) == "!" and _value(code, i - 1) and not code.breaks(i):
            yield _row("unnecessary-assertion", "double-non-null", code, i, "high")
        elif text == "!" and kind == "punct" and not code.breaks(i) and (code.ended(i + 1) or code.at(i + 1) == "."):
            literal = 0 < i and code.toks[i - 1][0] in ("string", "template", "number")
            start = code.mate.get(i - 1)
            if literal or start is not None and code.at(start) in "[{" and code.at(start - 1) in ("=", "(", ",", "return", "["):
                yield _row("unnecessary-assertion", "redundant-non-null-on-literal", code, i, "high")
        elif text == "<" and not tsx and code.at(i - 1) in ("=", "(", ",", "return", "=>", "[") and code.is_name(i + 1):
            _, k = code.dotted_from(i + 1)
            if code.at(k) == ">" and (code.is_name(k + 1) or code.at(k + 1) in ("{", "[") or code.at(k + 1) == "(" and code.at(code.mate.get(k + 1, k) + 1) not in ("=>", ":")):
                yield _row("unnecessary-assertion", "angle-bracket-assertion", code, i, "medium")


def _value_or_brace(code: Code, i: int) -> bool:
    return _value(code, i) or code.at(i) == "}"


def types(code: Code) -> Iterator[tuple[str, str, int, int, int]]:
    """Types declared at the top: name, shape, line, and the tokens of the body.

    The shape is a hash of the members in order of their text, without `?` and `readonly`, and of heritage
    and parameters; names of the types themselves have no part in it.
    """
    i, depth = 0, 0
    while i < len(code.toks):
        text = code.at(i)
        depth += (text in _OPEN and i in code.mate) - (text in _CLOSE and i in code.mate)
        if depth == 0 and text in ("interface", "type") and code.is_name(i) and code.is_name(i + 1) and code.at(i - 1) not in (".", "import") and (text == "interface" or code.at(i + 2) in ("=", "<")):
            start = i + 2
            brace = start
            if text == "interface":
                while brace < len(code.toks) and code.at(brace) != "{":
                    brace += 1
                end = code.mate.get(brace, brace)
            else:
                while brace < len(code.toks) and code.at(brace) != "=":
                    brace += 1
                end = _end_of_type(code, brace + 1)
                brace = brace + 1
            head = " ".join(code.at(k) for k in range(start, brace))
            yield code.at(i + 1), hashlib.sha256(f"{text}:{head}:{_shape(code, brace, end)}".encode()).hexdigest(), code.line(code.toks[i][2]), start, end
            i = end
        i += 1


def _end_of_type(code: Code, k: int) -> int:
    """The last token of the type that begins at k."""
    while k < len(code.toks):
        if code.at(k) in _OPEN and k in code.mate:
            k = code.mate[k]
        nxt = code.at(k + 1)
        if nxt in ("", ";", "}") or code.breaks(k + 1) and nxt not in ("|", "&", "?", ":", "=>", ".", "[", "{", "(", "extends") and code.at(k) not in ("|", "&", "=", "=>", "?", ":", "extends", "keyof"):
            return k
        k += 1
    return len(code.toks) - 1


def _shape(code: Code, start: int, end: int) -> str:
    """Text of tokens start to end; the members of a brace are sorted, those within it too."""
    out, k = [], start
    while k <= end and k < len(code.toks):
        if code.at(k) == "{" and k in code.mate and code.mate[k] <= end:
            members, first, j = [], k + 1, k + 1
            while j <= code.mate[k]:
                over = j == code.mate[k]
                if over or code.at(j) in (";", ",") or j > first and code.breaks(j) and code.at(j) not in ("|", "&"):
                    member = _shape(code, first, j - 1)
                    if member:
                        members.append(member)
                    first = j + (code.at(j) in (";", ",") or over)
                j = code.mate[j] + 1 if not over and j in code.mate and code.at(j) in _OPEN else j + 1
            out.append("{" + ";".join(sorted(members)) + "}")
            k = code.mate[k]
        elif code.at(k) != "readonly" and not (code.at(k) == "?" and code.at(k + 1) == ":"):
            out.append(code.at(k))
        k += 1
    return " ".join(out)


def leaks(code: Code, declared: list[tuple[str, str, int, int, int]], exported: set[str]) -> Iterator[dict]:
    """Signatures of exported functions and variables that name a type of this file which is not exported."""
    private = {name for name, *_ in declared} - exported
    seen: set[tuple[str, str]] = set()
    for i, (kind, text, _) in enumerate(code.toks):
        if text != "export" or kind != "name" or not private:
            continue
        k = i + 1
        while code.at(k) in ("default", "async", "declare", "abstract"):
            k += 1
        what, k = code.at(k), k + 1
        k += code.at(k) == "*"
        name = code.at(k) if code.is_name(k) else "default"
        if what == "function":
            span = _signature(code, k)
        elif what in _BINDS and code.at(k + 1) == ":":
            span = range(k + 2, next((j for j in range(k + 2, len(code.toks)) if code.at(j) in ("=", ";")), len(code.toks)))
        elif what in _BINDS and code.at(k + 1) == "=" and code.at(k + 2 + (code.at(k + 2) == "async")) in ("(", "<"):
            span = _signature(code, k + 2)
        else:
            continue
        for j in span:
            if code.is_name(j) and code.at(j) in private and code.at(j - 1) != "." and code.at(j + 1) not in (":", "?") and (name, code.at(j)) not in seen:
                seen.add((name, code.at(j)))
                yield _row("private-type-leak", f"{name}:{code.at(j)}", code, j, "high")


def _signature(code: Code, k: int) -> range:
    """Tokens from k through parameters and type of result, up to the body."""
    start = k
    while k < len(code.toks) and code.at(k) != "(":
        k += 1
    k = code.mate.get(k, k) + 1
    while k < len(code.toks) and code.at(k) not in ("{", "=>", ";", "="):
        k += 1
    return range(start, min(k, len(code.toks)))

