"""URL filters: longest matching rule, else link-graph propagation of trust and distrust.

Hosts under allow rules seed a personalised PageRank along links: a host shares its trust among all it links to, so
one of a thousand links of a trusted host lends a thousandth. Hosts under block rules seed one along reversed links
(a host that links to a blocked host is suspect), which a linker takes by the part of its own links: its distrust is
the chance that a walk from it, going on with chance `DAMPING` at each step, comes to a blocked seed, however many
others link there. Hosts that have no page here are judged by the links to them. Seeds rank 1. Ranks are settled when
none moves by more than `BOUND`. A host whose distrust reaches `LEAST` is blocked unless its trust does so too. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import only, pin, small

#: Chance of going on, and the distrust that blocks: about that of a host with half of its links to blocked hosts.
DAMPING, LEAST = 0.85, 0.4
#: Largest move of a rank that settles it, rounds after which it must have settled (moves shrink by `DAMPING` a round, times
#: the number of seeds at first), and digits that are compared.
BOUND, MOST, DIGITS = 1e-4, 300, 3
#: A host is a seed if more than this share of its pages (or, if it has none, of the paths linked to) fits allow (or block) rules.
SEED_SHARE = 0.5
HREF = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; empty if there is none or the url is null."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits, or null; of equally long ones the first as named in `rules`."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        found = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r.name).otherwise(found)
    return found


def _share(edges: DataFrame, seeds: DataFrame, a: str, b: str) -> DataFrame:
    """Edges a -> b with the part of its page's host's links that each is. Seeds take nothing from others."""
    shared = edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n") / F.col("all")).alias("w"))
    return pin(shared.join(small(seeds.select(F.col("host").alias("b"))), "b", "left_anti"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, bound: float = BOUND, most: int = MOST) -> DataFrame:
    """host, rank from seeds (host; rank 1) along edges (a, b, w), until no rank moves by more than `bound`.

    A round joins on the host that gives and sums by the one that takes; its result is written, so a lost executor costs
    no earlier round. It raises an error rather than return ranks that have not settled.
    """
    base = rank = pin(seeds.select("host", F.lit(1.0).alias("rank")))
    for _ in range(most):
        sent = edges.join(rank, edges.a == rank.host).select(F.col("b").alias("host"), (F.col("rank") * F.col("w") * damping).alias("rank"))
        now = pin(base.unionByName(sent).groupBy("host").agg(F.sum("rank").alias("rank")))
        moves = now.unionByName(rank.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("move"))
        rank = now
        if (moves.agg(F.max("move")).first()[0] or 0) <= bound:
            return rank
    raise RuntimeError(f"ranks did not settle in {most} rounds")


def _target(url: Column) -> Column:
    """Host of a link, which may leave out the scheme."""
    return host_of(F.when(url.startswith("//"), F.concat(F.lit("x:"), url)).otherwise(url))


def _hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))


def links(pages: DataFrame) -> DataFrame:
    """Host edges of the pages' links to other hosts: src, dst, n (pages with that link). Needs host and html."""
    targets = F.array_distinct(F.transform(_hrefs(F.col("html")), _target))
    pairs = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def linked(pages: DataFrame) -> DataFrame:
    """The different host and path of all links to other hosts. Needs host and html."""
    urls = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(_hrefs(F.col("html")))).alias("url")).where("src <> ''")
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), "url")).otherwise(F.col("url"))
    return urls.select("src", host_of(url).alias("host"), path_of(url).alias("path")).where("host <> '' and host <> src").select("host", "path").distinct()


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, bound: float = BOUND, least: float = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Null or odd urls have no host and are allowed; repeated rows get equal verdicts; an empty table
    gives an empty result. Null html has no links; of a very long one all links are read, in the row's own task.
    """
    pages = only(pages, page_id=id_col, url=url_col, html=html_col)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for r in rules:
        verdicts = F.when(F.col("rule") == r.name, r.verdict).otherwise(verdicts)
    rows = rows.withColumn("by_rule", verdicts)
    seen = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    hosts = pin(seen)
    edges = pin(links(rows))
    if not edges.isEmpty():
        told = linked(rows).join(hosts.select("host"), "host", "left_anti").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdicts)
        hosts = pin(hosts.unionByName(told.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))))
    good = hosts.where(F.col("allowed") > F.col("n") * SEED_SHARE).select("host")
    bad = hosts.where(F.col("blocked") > F.col("n") * SEED_SHARE).select("host")
    if edges.isEmpty():
        trust, distrust = (seeds.select("host", F.lit(1.0).alias("rank")) for seeds in (good, bad))
    else:
        trust = propagate(good, _share(edges, good, "src", "dst"), damping, bound)
        distrust = propagate(bad, _share(edges, bad, "dst", "src"), damping, bound)
    distrust = distrust.select("host", F.round("rank", DIGITS).alias("distrust"))
    sure = trust.where(F.round("rank", DIGITS) >= least).select("host")
    shunned = distrust.where(F.col("distrust") >= least).join(sure, "host", "left_anti").select("host", F.lit(True).alias("shunned"))
    out = rows.drop("html").join(small(shunned), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("shunned"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle_sql(rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, rounds: int = 60, least: float = LEAST) -> str:
    """The same verdicts in DuckDB SQL, a common table expression for each round: `rounds` of them move ranks by 0.85^60 at last."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host, path = low.format("regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's')"), "regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    by_length = sorted(rules, key=lambda r: -len(r.name))
    fits = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in by_length)
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules)
    href = HREF.replace("(?i)", "").replace("'", "''")
    parts = [
        f"p AS (SELECT page_id, html, coalesce({host.format('url')}, '') AS host, coalesce({path.format('url')}, '') AS path FROM pages)",
        f"r AS (SELECT *, CASE {fits} END AS rule FROM p)",
        f"v AS (SELECT *, CASE rule {verdict} END AS by_rule FROM r)",
        f"l AS (SELECT DISTINCT page_id, src, {host.format('u')} AS dst, {path.format('u')} AS path FROM (SELECT page_id, src, CASE WHEN starts_with(u, '//') THEN 'x:' || u ELSE u END AS u FROM (SELECT page_id, host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1, 'i')) AS u FROM v)))",
        "o AS (SELECT page_id, src, dst, path FROM l WHERE src <> '' AND dst <> '' AND src <> dst), e AS (SELECT src, dst, count(DISTINCT page_id) AS n FROM o GROUP BY src, dst)",
        f"x AS (SELECT host, CASE rule {verdict} END AS by_rule FROM (SELECT host, CASE {fits} END AS rule FROM (SELECT DISTINCT dst AS host, path FROM o WHERE dst NOT IN (SELECT host FROM v))))",
        "h AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM (SELECT host, by_rule FROM v UNION ALL FROM x) WHERE host <> '' GROUP BY host)",
    ]
    for name, share, a, b in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        parts += [f"{name}s AS (SELECT host, 1.0::double AS rank FROM h WHERE {share} > n * {SEED_SHARE})", f"{name}w AS (SELECT {a} AS a, {b} AS b, w FROM (SELECT *, n / sum(n) OVER (PARTITION BY src) AS w FROM e) WHERE {b} NOT IN (SELECT host FROM {name}s))", f"{name}0 AS (SELECT * FROM {name}s)"]
        parts += [f"{name}{i + 1} AS (SELECT host, sum(rank) AS rank FROM (SELECT * FROM {name}s UNION ALL SELECT b, rank * w * {damping} FROM {name}{i} JOIN {name}w ON a = host) GROUP BY host)" for i in range(rounds)]
    parts.append(f"bad AS (SELECT d.host FROM d{rounds} d LEFT JOIN t{rounds} t ON d.host = t.host WHERE round(d.rank, {DIGITS}) >= {least} AND round(coalesce(t.rank, 0), {DIGITS}) < {least})")
    return f"WITH {', '.join(parts)} SELECT page_id, v.host AS host, path, rule, coalesce(by_rule, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN bad ON v.host = bad.host"


OP10_SQL = oracle_sql()
