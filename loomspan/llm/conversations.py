"""Conversation prefix trie by partition refinement.

All distinct conversations start as one class. Each round splits every active class by its members' next turn and
retires the classes that are left with one conversation: its tail, from there on, is an unary chain. What lies below a
node (children, leaves, savings) is folded back from the deepest split to the root. Rounds are as many as the longest
prefix that two different conversations share; equal conversations count as one from the start. Rounds move 32 bytes of
each turn, never its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import only, pin, small, stored
from loomspan.operators.relational import ranked

#: A bin holds 2^12 ids of a node's members or turns of a tail: what one row or one group may hold.
BIN_BITS = 12
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0, by turn, null first), n (turns of the conversation), key (of role and text), size.

    Equal turns are ordered by role, then by key. key is a SHA-256, size the text's code points; null roles and texts
    count as empty. Rows without a conv_id belong to no conversation. Sorted as a whole: a conversation may be long.
    """
    rows = only(conversations, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id is not null").withColumns({"conv_id": F.col("conv_id").cast("long"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    slim = rows.select("conv_id", "turn", "role", key.alias("key"), F.length("text").cast("long").alias("size"))
    return ranked(slim, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("key")]).select("conv_id", "place", "n", "key", "size")


def grafted(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and turns (conv_id, place, key, size) with shared openings.

    Conversation c takes the first h turns of conversation c - c % `every` (all if there are fewer) in place of its own
    first h, h being crc32(c) % `most`. At most `every` conversations on either side of zero share a donor.
    """
    convs = turns.where("place = 0").select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("donor"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    given = turns.where((F.col("place") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("donor"), "place", "key", "size")
    lead = convs.join(given, "donor").where("place < h").select("conv_id", "place", "key", "size")
    lengths = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("there"))
    moved = convs.join(lengths, "donor", "left").select("conv_id", "h", (F.least("h", F.coalesce("there", F.lit(0))) - F.col("h")).alias("by"))
    own = turns.join(moved, "conv_id").where("place >= h").select("conv_id", (F.col("place") + F.col("by")).alias("place"), "key", "size")
    return convs.select("conv_id"), lead.unionByName(own)


def _ends(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """rep, n, weight, ends_sha256: each distinct conversation by its least id, its turns, how many are equal to it,
    and the digest of their ids in ascending order.

    Equal conversations are told by two 64-bit sums over (place, key), which add up before they move. Ids are gathered in
    bins of at most 4096; one task passes over a group's bins in order and holds one at a time.
    """
    hashed = [F.sum(F.xxhash64(F.lit(i), "place", "key").cast("decimal(38,0)")).alias(f"sum_{i}") for i in (1, 2)]
    signed = convs.join(turns.groupBy("conv_id").agg(F.count("*").alias("n"), *hashed), "conv_id", "left").fillna(0, ["n"])
    zero = F.lit(0).cast("decimal(38,0)")
    by = ["n", "sum_1", "sum_2"]
    signed = signed.withColumns({c: F.coalesce(c, zero) for c in by[1:]})
    bins = signed.groupBy(*by, F.shiftright("conv_id", BIN_BITS).alias("bin")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    key = F.concat_ws(":", *by)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, digest = None, None, hashlib.sha256()
        for b in it:
            out = []
            for k, n, rep, weight, ids in zip(*(b.column(c).to_pylist() for c in ("by", "n", "rep", "weight", "ids")), strict=True):
                if k == now:
                    digest.update(b"," + ids.encode())
                    row["weight"] += weight
                    continue
                if row:
                    out.append(row | {"ends_sha256": digest.hexdigest()})
                now, row, digest = k, {"rep": rep, "n": n, "weight": weight}, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if row:
            yield pa.RecordBatch.from_pylist([row | {"ends_sha256": digest.hexdigest()}], schema)

    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("weight", pa.int64()), ("ends_sha256", pa.string())])
    sorted_bins = bins.select(key.alias("by"), "n", "bin", "rep", "weight", "ids").repartition("by").sortWithinPartitions("by", "bin")
    return pin(sorted_bins.select("by", "n", "rep", "weight", "ids").mapInArrow(run, "rep long, n long, weight long, ends_sha256 string"))


def _below(tails: DataFrame) -> DataFrame:
    """`tails` (rep, place, size, ...) with below: the sizes from the place to the end, added up by bins of turns."""
    binned = tails.withColumn("bin", F.shiftright("place", BIN_BITS))
    sums = binned.groupBy("rep", "bin").agg(F.sum("size").alias("total"))
    after = F.sum("total").over(Window.partitionBy("rep").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("size").over(Window.partitionBy("rep", "bin").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    rest = sums.select("rep", "bin", F.coalesce(after, F.lit(0)).alias("after"))
    return binned.withColumn("within", within).join(rest, ["rep", "bin"]).withColumn("below", F.col("within") + F.col("after")).drop("bin", "within", "after")


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id; also those without a turn) over turns (conv_id, place from 0, key, size).

    A node is a distinct sequence of first turns; one row for each: conv_id (the smallest member, which with the depth
    names it), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree,
    (n_convs - 1) times the size of each node's last turn), ends_sha256 (of the decimal ids of the members that end
    there, comma-joined). No conversations make no nodes. Equal conversations share all their nodes.
    """
    spark = convs.sparkSession
    turns = stored(turns.repartitionByRange("place", "conv_id").sortWithinPartitions("place", "conv_id"))  # a round reads one place
    ends = _ends(convs, turns)
    whole = ends.agg(F.min("rep").alias("rep"), F.count("*").alias("reps"), F.sum("weight").alias("weight")).first()
    if not whole.reps:
        return spark.createDataFrame([], _NODE)
    none = F.lit(None).cast("long")
    top = ends.where(F.col("rep") == whole.rep).select(F.col("rep").alias("node"), none.alias("parent"), F.lit(whole.weight).cast("long").alias("convs"), F.lit(0).cast("long").alias("size"))
    levels: list[DataFrame] = []  # of each depth, the nodes of two distinct conversations or more
    ended: list[DataFrame] = []  # and which conversation ends there, at most one a node
    lone: list[DataFrame] = []  # conversations that are alone from a depth on
    if whole.reps == 1:
        lone.append(top.select("node", "parent", F.lit(0).cast("long").alias("depth")))
    else:
        levels.append(pin(top))
        active = ends.select("rep", "n", "weight", F.lit(whole.rep).alias("node"))
        while True:
            depth = len(levels)
            ended.append(active.where(F.col("n") == depth - 1).select("node", "rep"))
            now = turns.where(F.col("place") == depth - 1).select(F.col("conv_id").alias("rep"), "key", "size")
            met = pin(active.join(now, "rep"))
            made = pin(met.groupBy("node", "key").agg(F.count("*").alias("reps"), F.min("rep").alias("least"), F.sum("weight").alias("convs"), F.first("size").alias("size")))
            lone.append(made.where("reps = 1").select(F.col("least").alias("node"), F.col("node").alias("parent"), F.lit(depth).cast("long").alias("depth")))
            split = made.where("reps > 1")
            if split.isEmpty():
                break
            levels.append(split.select(F.col("least").alias("node"), F.col("node").alias("parent"), "convs", "size"))
            active = met.join(small(split.select("node", "key", "least")), ["node", "key"]).select("rep", "n", "weight", F.col("least").alias("node"))

    alone = lone[0]
    for x in lone[1:]:
        alone = alone.unionByName(x)
    alone = pin(alone.join(ends.select(F.col("rep").alias("node"), "n", "weight", "ends_sha256"), "node"))
    # A lone conversation's nodes from its depth on. Its first one may be the root, which has no turn.
    tails = alone.join(turns.withColumnRenamed("conv_id", "node"), "node").where("place >= depth - 1").select(F.col("node").alias("rep"), "place", "size", F.col("depth").alias("since"), "parent", "n", "weight", "ends_sha256")
    many = _below(tails.where("weight > 1"))
    tails = pin(tails.where("weight = 1").withColumn("below", F.lit(0).cast("long")).unionByName(many))
    root = alone.where("depth = 0").join(many.groupBy("rep").agg(F.sum("size").alias("below")), F.col("node") == F.col("rep"), "left").select(F.col("node").alias("rep"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("since"), "parent", "n", "weight", "ends_sha256", F.coalesce("below", F.lit(0)).alias("below"))
    chains = tails.drop("size").unionByName(root)
    at = F.col("place") + 1
    out = chains.select(
        F.col("rep").alias("conv_id"),
        at.alias("depth"),
        F.when(at == F.col("since"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"),
        (at < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(at == F.col("n"), F.col("ends_sha256")).otherwise(_EMPTY).alias("ends_sha256"),
    )

    first = pin(chains.where("place + 1 = since").select("since", "parent", ((F.col("weight") - 1) * F.col("below")).alias("saved")))
    digests = ends.select("rep", "ends_sha256")
    under: DataFrame | None = None
    for depth in reversed(range(len(levels))):
        kids = first.where(F.col("since") == depth + 1).select("parent", F.lit(1).cast("long").alias("leaves"), "saved")
        kids = kids if under is None else kids.unionByName(under.select("parent", "leaves", "saved"))
        sums = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        own = (F.col("convs") - 1) * F.col("size")
        here = levels[depth].join(sums, "node", "left").join(ended[depth].join(digests, "rep").drop("rep"), "node", "left")
        under = pin(here.select("node", "parent", "convs", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))
        out = out.union(under.select("node", F.lit(depth).cast("long"), "parent", "convs", "children", "leaves", "saved", "ends_sha256"))
    return out


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*grafted(stored(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


#: A node by the digest of its turns' digests. Below a node lie the prefixes that begin with its own.
OP12_SQL = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', role, text))) AS i,
sha256(concat(length(coalesce(role, '')), ':', role, text)) AS k, length(coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 's': s} ORDER BY i) AS ts FROM t GROUP BY conv_id),
crc(b, r) AS (SELECT range, range FROM range(256)), c1 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM crc), c2 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c1),
c3 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c2), c4 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c3),
c5 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c4), c6 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c5),
c7 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c6), c8 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END AS r FROM c7),
steps AS (SELECT list(r ORDER BY b) AS step FROM c8),
h AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda r, x: xor(r >> 8, step[(xor(r, x) & 255) + 1]))) % 6 AS h FROM own, steps),
re AS (SELECT own.conv_id, list_concat(coalesce(d.ts[1:h], []), own.ts[h + 1:]) AS ts FROM own JOIN h USING (conv_id) LEFT JOIN own d ON d.conv_id = own.conv_id - own.conv_id % 100),
p AS (SELECT conv_id, len(ts) AS n, d, sha256(array_to_string(list_transform(ts[1:d], lambda x: x.k), ',')) AS p, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(ts[1:d - 1], lambda x: x.k), ',')) END AS up, CASE WHEN d > 0 THEN ts[d].s ELSE 0 END AS s
FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM re)),
nodes AS (SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(s) AS s, sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
paths AS (SELECT DISTINCT n.d, n.p, a.d AS ad, a.p AS ap FROM nodes n JOIN p b ON b.conv_id = n.conv_id JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d WHERE b.d = n.d),
sums AS (SELECT ad AS d, ap AS p, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * s) AS saved_tokens FROM paths x JOIN nodes n ON n.d = x.d AND n.p = x.p LEFT JOIN kids k ON k.d = x.d AND k.p = x.p GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::bigint AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN kids k ON k.d = n.d AND k.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.up"""
