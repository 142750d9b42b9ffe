"""HTML main text by equivalence classes of page tokens, deduced host by host.

A token is the role of a container element: its path of tags with their classes, known by a hash, so deep
pages cost no more than flat ones. For every host the tokens of its distinct pages are counted, and tokens
with the same occurrence vector (as often as each other on every page; compared by a sum of hashes, so no
vector is ever gathered) form an equivalence class. Frequent classes that lie in one slot of another class
nest into the host's template; a class that lies in several slots is parted. The article's slot is found
from the template's root downwards: on the pages that have it, it holds most of the text that is no link,
and no heading beside it; if the host's pages name their article, it lies nowhere else. Slots beside it
whose text is the same on every page, or mostly links, are no part of it. What a single page names an
article decides only where the template has no such slot on that page.
Menus, notices, comments and the like are left out by their tags, and by classes that say nothing else.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, only, pin, small
from loomspan.llm.url_filters import host_of

#: Least share of a host's distinct pages that have a token of the template; pages from which a template is
#: trusted before a page's own markup, and equal text counts as fixed; share of a slot's text that its article holds.
FREQUENT, FIXED_PAGES, DOMINANT = 0.2, 4, 0.7
#: Levels of containers that are told apart; deeper ones belong to the one at this level.
DEEPEST = 200

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CONTAINERS = frozenset("html head body header footer nav aside main article section div form table ul ol dl menu dialog details fieldset figure blockquote".split())
_NEVER = frozenset("head nav aside footer form script style noscript iframe template textarea title button select svg canvas object dialog menu".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words of class, id and role attributes; those that name what is no article, those that may stand beside them, and the article's.
_NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay widget widgets toolbar pagination pager login signup search copyright disclaimer skip masthead topbar contentinfo complementary".split())
_BESIDE = frozenset("site page main global primary secondary article post entry story blog news web top bottom left right side box wrap wrapper container block list area section bar unit inner outer slot item items link links button buttons text message msg content form thread group panel row col column zone module reader readers user users sticky fixed mobile desktop small large js is has the header body".split())
_MAIN_WORDS = frozenset("article articlebody post entry story content main maincontent body".split())

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*))")
_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _element(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Role, whether its content is never main text, and whether it calls itself the article."""
    if not attrs or attrs.isspace():
        return tag, tag in _NEVER, tag in ("article", "main")
    named = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    raw = " ".join(named.get(k, "") for k in ("class", "id", "role", "itemprop"))
    never = tag in _NEVER
    if tag not in ("html", "body", "main", "article"):
        for name in raw.split():
            words = [w.lower() for w in _SPLIT.split(_CAMEL.sub(" ", name)) if w]
            never |= any(w in _NEVER_WORDS for w in words) and all(w in _NEVER_WORDS or w in _BESIDE for w in words)
        never |= "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
    words = {w.lower() for w in _SPLIT.split(_CAMEL.sub(" ", raw)) if w}
    main = tag in ("article", "main") or (tag in _CONTAINERS and not never and bool({w.lower() for w in raw.split()} & _MAIN_WORDS or words & {"article", "articlebody", "story", "entry", "post"}))
    role = tag + "".join(f".{w}" for w in sorted(w.lower() for w in _SPLIT.split(raw) if w))
    return role, never, main


def _tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Text before a tag, `/` or nothing, the tag's name in small letters, its attributes; at last the text after all tags.

    Each character is looked at a bounded number of times: once a tag has no end outside of quotes, quotes no
    longer count.
    """
    at, size, quotes = 0, len(page), True
    start = 0
    while m := _OPEN.search(page, at):
        if m[3] is None:
            end = page.find("-->" if m[1] else ">", m.end())
            yield page[start : m.start()], "", "", ""
            start = at = size if end < 0 else end + (3 if m[1] else 1)
            continue
        last = _END.match(page, m.end()) if quotes else None
        quotes = last is not None
        end = last.end() - 1 if last else page.find(">", m.end())
        if end < 0:  # no tag ends any more
            break
        tag = m[3].lower()
        yield page[start : m.start()], m[2], tag, page[m.end() : end]
        start = at = end + 1
        if tag in _RAW and not m[2]:
            closed = re.compile(rf"</{re.escape(tag)}(?![A-Za-z0-9-])[^>]*>?", re.I).search(page, at)
            start = at = closed.end() if closed else size
    yield page[start:], "", "", ""


class Element:
    """An open element: tag, hash of its path, whether it is never main text, lies within a named article or in a wanted slot."""

    __slots__ = ("depth", "inside", "nested", "never", "path", "tag", "wanted")

    def __init__(self, tag: str, path: int, depth: int, never: bool, inside: bool, wanted: bool) -> None:
        self.tag, self.path, self.depth, self.never, self.inside, self.wanted, self.nested = tag, path, depth, never, inside, wanted, 1


class Reader:
    """Text blocks and container tokens of one page. Broken markup is read as far as it goes: open elements end with their parent or the page."""

    def __init__(self, page: str | None, slots: frozenset[int] = frozenset()) -> None:
        from xxhash import xxh64_intdigest

        self.blocks: list[tuple[int, bool, bool, bool, str]] = []  # path, never, inside a named article, in a wanted slot, text
        self.tokens: dict[int, list] = {0: [-1, "", 1, 0, 0, False, False]}  # path -> parent, tag, times, own chars, own link chars, has an own h1, calls itself the article
        self.main, self.met = False, False
        self.hash, self.slots = xxh64_intdigest, slots
        self.stack = [Element("", 0, 0, False, False, False)]
        self.open: dict[str, int] = {}
        self.scopes: list[dict[str, list[int]]] = [{}]
        self.text: list[str] = []
        self.linked = self.link = 0
        for before, slash, tag, attrs in _tags(page or ""):
            if before:
                self.text.append(html_lib.unescape(before))
                if self.link:
                    self.linked += len(before)
            if tag and tag in _INLINE:
                self.inline(tag, bool(slash), attrs)
            elif tag:
                self.block(tag, bool(slash), attrs)
        self.flush()

    def flush(self) -> None:
        if self.text:
            joined = " ".join("".join(self.text).split())
            self.text.clear()
            if joined:
                top = self.stack[-1]
                self.blocks.append((top.path, top.never, top.inside, top.wanted, joined))
                token = self.tokens.get(top.path)
                if token and not top.never:
                    links = min(self.linked, len(joined))
                    token[3] += len(joined) - links
                    token[4] += links
                    token[5] |= self.open.get("h1", 0) > 0
        self.linked = 0

    def pop(self, length: int) -> None:
        """Close all elements from place `length` of the stack on."""
        for e in reversed(self.stack[length:]):
            self.open[e.tag] -= 1
            if e.tag in _CONTAINERS:
                self.scopes.pop()
            self.scopes[-1][e.tag].pop()
        del self.stack[length:]
        if self.link > len(self.stack):
            self.link = 0

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            i = len(self.stack) - 1
            while self.stack[i].tag != tag:
                i -= 1
            self.pop(i)

    def push(self, e: Element) -> None:
        self.scopes[-1].setdefault(e.tag, []).append(len(self.stack))
        if e.tag in _CONTAINERS:
            self.scopes.append({})
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        self.stack.append(e)

    def inline(self, tag: str, closes: bool, attrs: str) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.link = 0 if closes else len(self.stack)
        if tag in ("br", "img", "wbr"):
            return
        top = self.stack[-1]
        if not closes:
            if attrs and _element(tag, attrs)[1]:  # an inline advert or notice: what it holds is no part of the block
                self.flush()
                self.push(Element(tag, top.path, top.depth, True, top.inside, top.wanted))
            elif top.tag == tag:
                top.nested += 1
        elif self.open.get(tag):
            if top.tag == tag:
                top.nested -= 1
            if top.tag != tag or not top.nested:
                self.flush()
                self.close(tag)

    def block(self, tag: str, closes: bool, attrs: str) -> None:
        self.flush()
        if closes:
            self.close(tag)
            return
        scope = self.scopes[-1]
        if tag in _CLOSES_P and scope.get("p"):
            self.pop(scope["p"][-1])
        places = [scope[t][-1] for t in _SIBLINGS.get(tag, ()) if scope.get(t)]
        if places:
            self.pop(min(places) if tag == "tr" else max(places))
        if tag in _VOID or tag in _RAW or attrs.endswith("/") and tag not in _CONTAINERS:
            return
        role, never, main = _element(tag, attrs)
        top = self.stack[-1]
        never |= tag == "header" and not top.inside and top.tag in ("", "html", "body")
        e = Element(tag, top.path, top.depth, top.never or never, top.inside, top.wanted)
        if (tag in _CONTAINERS or never or main) and top.depth < DEEPEST:
            e.path, e.depth = self.hash(role, top.path) >> 1, top.depth + 1
            token = self.tokens.setdefault(e.path, [top.path, tag, 0, 0, 0, False, False])
            token[2] += 1
            if main and not e.never:
                token[6] = e.inside = self.main = True
            if e.path in self.slots:
                e.wanted = self.met = True
        self.push(e)

    def under(self) -> dict[int, int]:
        """Characters under each path that are no links and not left out; paths come after their parents."""
        out = {path: t[3] for path, t in self.tokens.items()}
        for path, t in reversed(self.tokens.items()):
            if t[0] in out:
                out[t[0]] += out[path]
        return out


_FIELDS = {"host": T.StringType(), "page": T.LongType(), "path": T.LongType(), "parent": T.LongType(), "tag": T.StringType(), "n": T.IntegerType(), "under": T.LongType(), "above": T.LongType(), "links": T.LongType(), "chars": T.LongType(), "heading": T.BooleanType(), "says_main": T.BooleanType(), "text_hash": T.LongType()}


def tokens(pages: DataFrame) -> DataFrame:
    """The container tokens of each page of `pages` (page, host, html).

    host, page, path, parent, tag, n (times on the page), under and above (characters that are no links,
    below it and below its parent), links and chars (own, link and all), heading (it holds an h1), says_main,
    text_hash (of its own text).
    """
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.bool_(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64

        for b in it:
            rows = []
            for page, host, html in zip(*(b.column(c).to_pylist() for c in ("page", "host", "html")), strict=True):
                read = Reader(html)
                under, texts = read.under(), {}
                for path, _, _, _, text in read.blocks:
                    texts.setdefault(path, xxh64()).update(text + "\n")
                for path, (parent, tag, n, own, links, heading, says_main) in read.tokens.items():
                    if path:
                        rows.append((host, page, path, parent, tag, n, under[path], under[parent], links, own + links, heading, says_main, texts[path].intdigest() >> 1 if path in texts else 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_FIELDS))

    return pages.select("page", "host", "html").mapInArrow(run, T.StructType([T.StructField(k, t) for k, t in _FIELDS.items()]))


def templates(toks: DataFrame, pages_of: DataFrame, frequent: float = FREQUENT) -> DataFrame:
    """host, main (paths of the article's slots), dropped (paths of other slots that are no main text), pages.

    Pages with equal html count once. Only tokens on at least `frequent` of a host's pages come together
    for a host, so their number is bounded by the tokens of a few pages.
    """
    once = toks.dropDuplicates(["host", "page", "path"])
    roles = once.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).cast("string").alias("vector"), F.min("parent").alias("parent"), F.min("tag").alias("tag"), *(F.sum(c).alias(c) for c in ("under", "above", "links", "chars")),
        F.count_if("heading").alias("headings"), F.bool_or("says_main").alias("says_main"), (F.min("text_hash") == F.max("text_hash")).alias("same"),
    )
    roles = roles.join(small(pages_of), "host").where(F.col("pages") >= F.col("all_pages") * frequent)
    by_host = roles.groupBy("host").agg(F.first("all_pages").alias("pages"), F.collect_list(F.struct("path", "pages", "vector", "parent", "tag", "under", "above", "links", "chars", "headings", "says_main", "same")).alias("roles"))

    def deduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in it:
            made = [template(roles, n) for roles, n in zip(b.column("roles").to_pylist(), b.column("pages").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([m for m, _ in made], kind), pa.array([d for _, d in made], kind), b.column("pages")], ["host", "main", "dropped", "pages"])

    return by_host.mapInArrow(deduce, "host string, main array<long>, dropped array<long>, pages long")


def classes(roles: list[dict]) -> list[list[dict]]:
    """Equivalence classes of a host's tokens, each within one slot: equal vectors, and one parent outside of the class."""
    by_vector: dict[str, list[dict]] = {}
    for r in sorted(roles, key=lambda r: r["path"]):
        by_vector.setdefault(r["vector"], []).append(r)
    out = []
    for same in by_vector.values():
        paths, slots = {r["path"]: r for r in same}, {}
        for r in same:
            top = r
            while top["parent"] in paths:
                top = paths[top["parent"]]
            slots.setdefault(top["parent"], []).append(r)
        out += slots.values()
    return out


def template(roles: list[dict], pages: int) -> tuple[list[int], list[int]]:
    """The article's slots, and the other slots that are no main text, from a host's frequent tokens.

    Classes nest from the root's down; one whose slot is in no class of the template is left out.
    """
    waiting, inner, known = classes(roles), {}, {0}
    while True:
        fits = [c for c in waiting if any(r["parent"] in known for r in c)]
        if not fits:
            break
        waiting = [c for c in waiting if c not in fits]
        for c in fits:
            known |= {r["path"] for r in c}
            for r in c:
                inner.setdefault(r["parent"], []).append(r)
    main, deep = [], set()
    down = [({"path": 0, "tag": "", "headings": 0, "pages": pages, "under": 1, "says_main": False}, False)]
    while down:
        at, named = down.pop()
        named |= at["says_main"]
        kids = inner.get(at["path"], [])
        heads = {r["path"]: _headings(r, inner) for r in kids}
        within = [] if at["tag"] == "article" else [r for r in kids if r["above"] and r["under"] >= DOMINANT * r["above"]]
        within = [r for r in within if heads[r["path"]] or not at["headings"] and not any(n > at["pages"] / 2 for p, n in heads.items() if p != r["path"])]
        outer = [] if named else _outermost_named(at["path"], inner)
        if outer:  # the host's pages name their article: not beside it
            within = [r for r in within if r["says_main"] or _outermost_named(r["path"], inner)]
        down += [(r, named) for r in within]
        ends = [] if within else outer or [at] * (at["tag"] not in ("", "html", "body") and at["under"] > 0)
        main += [r["path"] for r in ends]
        deep |= {p for r in ends for p in (r["path"], *_below(r["path"], inner))}
    fixed = [r["path"] for rows in inner.values() for r in rows if r["path"] not in deep and r["chars"] and pages >= FIXED_PAGES and r["pages"] >= FIXED_PAGES and (r["same"] or 2 * r["links"] > r["chars"])]
    return sorted(main), sorted(fixed)


def _outermost_named(path: int, inner: dict[int, list[dict]]) -> list[dict]:
    """Slots below `path` that call themselves the article and hold text, without those within others of them."""
    out, down = [], [path]
    while down:
        for r in inner.get(down.pop(), ()):
            if r["says_main"] and r["under"]:
                out.append(r)
            else:
                down.append(r["path"])
    return out


def _below(path: int, inner: dict[int, list[dict]]) -> Iterator[int]:
    down = [path]
    while down:
        for r in inner.get(down.pop(), ()):
            yield r["path"]
            down.append(r["path"])


def _headings(r: dict, inner: dict[int, list[dict]]) -> int:
    """Pages on which a slot or one in it has an h1 with text that is not the same everywhere."""
    most, down = 0, [r]
    while down:
        r = down.pop()
        if not r["same"]:
            most = max(most, r["headings"])
        down += inner.get(r["path"], ())
    return most


def main_text(page: str | None, main: list[int] | None, dropped: list[int] | None, pages: int | None) -> str:
    """Text of the article's slot on this page; of what the page itself names the article if it has none, or the host too few pages; else of all slots that the template doesn't drop."""
    read = Reader(page, frozenset(main or ()))
    gone = frozenset(dropped or ())
    blocks = [x for x in read.blocks if not x[1]]
    own = [text for _, _, inside, _, text in blocks if inside]
    if read.met and ((pages or 0) >= FIXED_PAGES or not own):
        chosen = [text for path, _, _, wanted, text in blocks if wanted and path not in gone]
        if chosen:
            return "\n".join(chosen)
    return "\n".join(own or [text for path, *_, text in blocks if path not in gone])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null html is an empty page; pages without a host share a template; repeated rows come out as often;
    an empty table gives an empty result. Templates go to the pages by a join on the host, a broadcast
    only if they are few (counted).
    """
    batches(pages.sparkSession, 500)
    rows = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    keyed = rows.select("host", F.xxhash64("html").alias("page"), "html")
    pages_of = pin(keyed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all_pages")))
    made = pin(templates(tokens(keyed), pages_of))
    joined = rows.join(small(made), "host", "left").select("page_id", "url", "html", "main", "dropped", "pages")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(*x) for x in zip(*(b.column(c).to_pylist() for c in ("html", "main", "dropped", "pages")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
