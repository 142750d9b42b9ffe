"""Personal data: base patterns, and the same patterns in a deobfuscated text whose offsets lead back to the source.

Transducers rewrite a text in layers: look-alike characters and invisible ones, digits spelled as words, disguised at
signs and dots. Each layer keeps what it replaced, so a span found in the last one is mapped back through all of them.
What the base patterns find in the source stays; of the rewritten text, spans count that hold something rewritten.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, only

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Possessive, and from the first digit of a run on: a run that fails from there fails from any digit of it.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_DOUBLED = {d: int(d) * 2 - 9 * (int(d) > 4) for d in "0123456789"}


def _luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[d] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one at sign to the next, as no local part holds one; so time grows with the text's length."""
    last, at = 0, text.find("@")
    while at >= 0:
        end = at
        if (m := _DOMAIN.match(text, at + 1)) and at > last and _LOCAL.match(text, at - 1):
            start = at
            while start - 64 >= last and len(_LOCAL_END.search(text[start - 64 : start])[0]) == 64:
                start -= 64
            start -= len(_LOCAL_END.search(text[max(last, start - 64) : start])[0])
            end = m.end()
            yield start, end
            last = end
        else:
            last = at + 1
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base patterns, leftmost and non-overlapping for each kind."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Layer:
    """A text after replacements (start, end, by; ascending, apart) and the way back to the text before."""

    def __init__(self, before: str, edits: Iterable[tuple[int, int, str]]) -> None:
        self.at: list[int] = []  # where each replacement begins in the new text,
        self.to: list[int] = []  # where it ends,
        self.src: list[tuple[int, int]] = []  # and what it stands for
        out, last, n = [], 0, 0
        for s, e, by in edits:
            out += [before[last:s], by]
            n += s - last
            self.at.append(n)
            n += len(by)
            self.to.append(n)
            self.src.append((s, e))
            last = e
        self.text = "".join([*out, before[last:]])

    def __bool__(self) -> bool:
        return bool(self.at)

    def _of(self, i: int) -> tuple[int, int]:
        """Start and end, in the text before, of what character i comes from."""
        k = bisect_right(self.at, i) - 1
        if k >= 0 and i < self.to[k]:
            return self.src[k]
        x = i if k < 0 else self.src[k][1] + i - self.to[k]
        return x, x + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._of(start)[0], self._of(end - 1)[1]


def _look_alikes() -> dict[int, str]:
    """One character for each that looks like an ASCII one: full-width and mathematical forms, digits of other scripts,
    spaces and dashes by rule, letters by the list below."""
    out = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {c: n for c in range(0x1D400, 0x1D800) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
    out |= {c: str(d) for c in range(0x100, 0x20000) if c not in out and (d := unicodedata.decimal(chr(c), None)) is not None}
    out |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
    out |= dict.fromkeys([*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63], "-")
    out |= dict.fromkeys([0x2024, 0x3002, 0xFE52, 0xFF61], ".") | {0xFE6B: "@"}
    cyrillic = zip("АВЕКМНОРСТХУЅІЈԌԚԜаеорсухѕіјһԁԛԝ", "ABEKMHOPCTXYSIJGQWaeopcyxsijhdqw", strict=True)
    greek = zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυα", "ABEZHIKMNOPTYXoivpua", strict=True)
    latin = zip("ıɑɡɩ", "iagi", strict=True)
    return out | {ord(a): b for pairs in (cyrillic, greek, latin) for a, b in pairs}


FOLD = _look_alikes()
#: Zero-width space, joiners, word joiner, byte order mark and soft hyphen.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_FOLDED = frozenset(map(chr, FOLD)) | frozenset(INVISIBLE)
_ESCAPED = re.compile(r"&#0*64;|&#x0*40;|&commat;|%40|&#0*46;|&#x0*2e;|&period;|%2e", re.I | re.A)

#: Digits in English, German, French and Spanish.
WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = rf"(?:(?:double|triple)[\x20-])?(?:{'|'.join(sorted(WORDS, key=len, reverse=True))})\b"
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_BRACKETED_DOT = rf"[\x20\t]*+[\[({{<][\x20\t]*+(?:{_DOT_WORD}|\.)[\x20\t]*+[\])}}>][\x20\t]*+"
_DOT = rf"(?:{_BRACKETED_DOT}|[\x20\t]++{_DOT_WORD}[\x20\t]++|[_-]{_DOT_WORD}[_-]|[\x20\t]++\.[\x20\t]*+|\.[\x20\t]++)"
_ITEM = rf"(?:\b{_WORD}|[0-9]++)"
_GAP = rf"(?:{_DOT}|\.|[\x20,()-]{{1,4}}+)"
#: Spelled digits, and digits between or beside them.
_RUN = re.compile(rf"(?:\bplus[\x20]+)?(?:{_ITEM}{_GAP})*?\b{_WORD}(?:{_GAP}{_ITEM})+", re.I)
_PART = re.compile(rf"(plus)[\x20]+|\b({_WORD})|([0-9]++)|({_GAP})", re.I)
_TIMES = {"double": 2, "triple": 3}
#: Letters for digits within a group of digits.
_MIXED = re.compile(r"(?<![A-Za-z0-9@._%+-])(?=[OoIl]*[0-9])[0-9OoIl]+(?:[\x20.-][0-9OoIl]+)*(?![A-Za-z0-9@])|(?<=\+)(?=[OoIl]*[0-9])[0-9OoIl]+(?:[\x20.()-]+[0-9OoIl]+)*(?![A-Za-z0-9@])")
_LETTER = re.compile("[OoIl]")
_AS_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}

_AT = re.compile(rf"[\x20\t]*+[\[({{<][\x20\t]*+(?:at|@|arroba|ät)[\x20\t]*+[\])}}>][\x20\t]*+|[\x20\t]++(?:at|arroba)[\x20\t]++|[_-](?:at|arroba)[_-]|[\x20\t]++@[\x20\t]*+|@[\x20\t]++", re.I)
_AT_HINT = re.compile(rf"{_AT.pattern}|@", re.I)
_LABEL = re.compile(r"[A-Za-z0-9]++(?:-(?!(?:dot|punkt|punto|point)-)[A-Za-z0-9]++)*+", re.I)
_DOT_HERE, _PLAIN_DOT = re.compile(_DOT, re.I), re.compile(r"\.(?=[A-Za-z0-9])")
_DOT_BEFORE = re.compile(rf"(?:{_DOT})\Z", re.I)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}+(?:(?:{_DOT}|\.)[0-9]{{1,3}}+){{3}}(?![0-9])", re.I)
#: Endings that a bare "x at y dot z" needs, as those words also make sentences.
ENDINGS = frozenset("com org net edu gov mil int info biz name io co me app dev ai eu uk us ca au nz ie de at ch fr be lu es pt it nl se no dk fi pl cz mx ar br cl in jp cn kr example test invalid local".split())

#: Words that make "x at the dot in" a sentence.
ARTICLES = frozenset("the a an this that these those his her its my your our their each every some any all der die das den dem ein eine le la les un une el los las una".split())


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Digits for words, in runs of three words side by side or of three dots. Words side by side make one number."""
    for m in _RUN.finditer(text):
        parts = [(p.start(), p.end(), p.lastindex, p[0].lower()) for p in _PART.finditer(text, m.start(), m.end())]
        dots = sum(k == 4 and ("." in w or re.search(_DOT_WORD, w) is not None) for _, _, k, w in parts)
        words = most = 0
        for _, _, k, w in parts:
            words = words + (w.startswith(("double", "triple")) + 1) if k == 2 else 0 if k == 3 else words
            most = max(most, words)
        if most < 3 and dots != 3:
            continue
        for i, (s, e, k, w) in enumerate(parts):
            if k == 1:
                yield s, e, "+"
            elif k == 2:
                times, _, word = w.replace("-", " ").rpartition(" ")
                yield s, e, WORDS[word] * _TIMES.get(times, 1)
            elif k == 4 and 0 < i < len(parts) - 1 and parts[i - 1][2] == parts[i + 1][2] == 2 and not w.strip(" ,-"):
                yield s, e, ""


def _unescaped(text: str) -> Iterator[tuple[int, int, str]]:
    return ((m.start(), m.end(), "@" if re.search("40|64|com", m[0]) else ".") for m in _ESCAPED.finditer(text))


def _mixed(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _MIXED.finditer(text):
        if m.end() - m.start() >= 7 and sum(c.isdigit() for c in m[0]) * 2 >= len(_NOT_DIGIT.sub("", m[0])) + len(_LETTER.findall(m[0])):
            for x in _LETTER.finditer(text, m.start(), m.end()):
                yield x.start(), x.end(), _AS_DIGIT[x[0]]


def _local_start(text: str, at: int, least: int) -> int:
    """Where the run of a local part's characters that ends at `at` begins, not before `least`."""
    while at > least and len(run := _LOCAL_END.search(text[max(least, at - 64) : at])[0]):
        at -= len(run)
        if len(run) < 64:
            break
    return at


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """At signs and dots for their disguises in what is an address as a whole."""
    least = 0
    for m in _AT_HINT.finditer(text):
        start = _local_start(text, m.start(), least)
        if start == m.start() or m.start() < least:
            continue
        sure, edits = m[0] != "@" and re.search(r"[\[({<@]", m[0]) is not None, []
        loud = m[0].strip() == "AT" and text[start : m.start()].upper() != text[start : m.start()]
        if m[0] != "@":
            edits.append((m.start(), m.end(), "@"))
        while (d := _DOT_BEFORE.search(text[max(least, start - 24) : start])) and re.search(r"[a-z\[]", d[0], re.I):
            before, end = start - len(d[0]), start
            further = _local_start(text, before, least)
            if further == before:
                break
            edits.append((before, end, "."))
            start = further
        label = _LABEL.match(text, m.end())
        if label and m[0].strip().isalpha() and label[0].lower() in ARTICLES:
            continue
        end, last, hidden = (label.end(), "", False) if label else (m.end(), "", False)
        while label:
            plain = _PLAIN_DOT.match(text, end)
            dot = plain or _DOT_HERE.match(text, end)
            if not dot or not (label := _LABEL.match(text, dot.end())):
                break
            bare = not plain and not re.search(r"[\[({<_-]", dot[0])
            if bare and label[0].lower() not in ENDINGS and not _more(text, label.end()):
                break
            if not plain:
                edits.append((dot.start(), dot.end(), "."))
                hidden |= re.search(r"[a-z\[({<]", dot[0], re.I) is not None
            end, last = label.end(), label[0].lower()
        if last and edits and len(last) >= 2 and not last.isdigit() and (hidden or m[0] == "@" or sure and (last in ENDINGS or m[0].strip() != "@") or loud and last in ENDINGS):
            yield from sorted(edits)
            least = end
        elif last and m[0] == "@":
            least = max(least, m.end())


def _more(text: str, at: int) -> bool:
    """Whether another dot and label follow."""
    dot = _PLAIN_DOT.match(text, at) or _DOT_HERE.match(text, at)
    return dot is not None and _LABEL.match(text, dot.end()) is not None


def _dotted(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DOTTED.finditer(text):
        for d in re.finditer(r"[^0-9]+", m[0]):
            if d[0] != ".":
                yield m.start() + d.start(), m.start() + d.end(), "."


def _folds(text: str) -> bool:
    """Whether a character has a look-alike or is invisible; of Latin-1 only two can be."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _FOLDED.isdisjoint(text)
    return "\xa0" in text or "\xad" in text


#: What a word may be part of: spelled digits (d), a spelled dot (p).
_ROLE = dict.fromkeys([*WORDS, *_TIMES], "d") | dict.fromkeys(["dot", "punkt", "punto", "point"], "p")
_TOKEN = re.compile(r"[^\W_]+")
_OPENED = re.compile(r"[\[({<][\x20\t]*(?:\.|at\b|@|arroba\b|ät\b)", re.I)
_NEAR_DIGIT = re.compile("[0-9][OoIl]|[OoIl][0-9]")


def deobfuscated(text: str) -> tuple[str, list[Layer]]:
    """The rewritten text, and the layers that lead back from it, the last one first. As long as the text: linear time."""
    now, layers = text, []
    if not text.isascii() and _folds(text):
        now = now.translate(FOLD)
        layers.append(Layer(now, ((m.start(), m.end(), "") for m in _INVISIBLE.finditer(now))))
        now = layers[-1].text
    role = _ROLE.get
    roles = "".join([role(w, " ") for w in _TOKEN.findall(now.lower())])  # no offsets: only which steps there is work for
    dots, opened = "p" in roles, _OPENED.search(now) is not None
    steps = [
        _unescaped if "&" in now or "%" in now else None,
        _mixed if _NEAR_DIGIT.search(now) else None,
        _spelled if "ddd" in roles or (dots and "d" in roles) else None,
        _addresses if dots or opened or "@" in now or " AT " in now or "&" in now or "%" in now else None,
        _dotted,
    ]
    for step in steps:
        if step and (layer := Layer(now, step(now))):
            layers.append(layer)
            now = layer.text
    return now, layers[::-1]


def spans_of(text: str | None) -> list[tuple[int, int, str, str, bool]]:
    """start, end, kind, value, base of all spans (code points), by start, then kind, then end. Null text has none.

    value is the identifier in clear. A span of the rewritten text counts if the source spells it otherwise and no
    base span of its kind covers it.
    """
    text = text or ""
    base = base_spans(text)
    out = [(s, e, k, text[s:e], True) for s, e, k in base]
    clear, layers = deobfuscated(text)
    if clear != text:
        sure = {(k, s): e for s, e, k in base}
        starts = {k: sorted(s for s, _, x in base if x == k) for k in KINDS}
        for s, e, kind in base_spans(clear):
            a, b = s, e
            for layer in layers:
                a, b = layer.back(a, b)
            i = bisect_right(starts[kind], a) - 1
            if text[a:b] != clear[s:e] and not (i >= 0 and sure[kind, starts[kind][i]] >= b):
                out.append((a, b, kind, clear[s:e], False))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("base", T.BooleanType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end, kind, value, base) for every row, by start, then kind, then end.

    Null and empty texts have no spans; repeated rows come out as often, with equal spans; an empty table gives an empty
    result. Only the id and the text are read, whatever other columns are named. Time grows with a text's length.
    """
    batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("base", pa.bool_())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [[dict(zip(("start", "end", "kind", "value", "base"), x, strict=True)) for x in spans_of(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("spans", _SPANS)]))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"size(filter(spans, x -> x.base and x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
