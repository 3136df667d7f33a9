"""Prefix trie of conversations (operator 12).

Conversations that are equal as a whole count once, with their number, so copies don't grow the trie. The others are dealt
by the digest of their first turn; the subtries of many first turns share a bucket, in which one pass builds pointer
dictionaries and another, from the last node to the first (children come after their parents), adds up leaves and tokens.
A first turn whose subtrie would be too large for a task isn't dealt out: its common run of turns is found from grouped
minima and maxima, those nodes are rows of that grouping, and what follows is dealt again by the next turn, as often as
needed. Sums of the subtries below come back through one join for each such round.

Turns are compared by 128 bits of hash of role and text. Rows: null role and text are empty ones, rows without conv_id
take no part; null turns come first, and rows that share a turn are in order of a hash of role and text, so repeated rows
are two turns. c % 20 has the sign of c. A turnless conversation ends at the root. Texts only count and hash, in Spark, so
their length doesn't matter. Columns other than conv_id, turn, role and text play no part. Empty tables give no nodes.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .turns import CRC_SQL, crc_sql, id_digests, ordered, placed

#: Turns of a subtrie that one task builds; buckets of several hold about as many.
MOST = 50_000
BLOCK = 20
WORD = "[^\\x20\\x09-\\x0D]+"
NODE = "key string, root boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, a, b, words) of the rebuilt turns, and (conv_id) of all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"),
    )
    own = materialize(placed(ordered(rows, "trie-order", "a", "b")).select("conv_id", "k", "a", "b", "words"), "trie-turns")
    heads = own.where(f"conv_id % {BLOCK} = 0 and k < 3").select(F.col("conv_id").alias("head"), "k", "a", "b", "words")
    every = own.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).withColumn("head", F.expr(f"conv_id - conv_id % {BLOCK}"))
    every = materialize(every.join(heads.groupBy("head").agg(F.count("*").alias("given")), "head", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0)))), "trie-conversations")
    copied = every.join(heads, "head").where("k < h").select("conv_id", (F.col("k") + 1).alias("depth"), "a", "b", "words")
    kept = own.join(every.select("conv_id", "h", "taken"), "conv_id").where("k >= h").select("conv_id", (F.col("taken") + F.col("k") - F.col("h") + 1).alias("depth"), "a", "b", "words")
    return materialize(copied.unionByName(kept), "trie-paths"), every.select("conv_id")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries, whose roots are the turns at which their rows begin."""
    pdf = pdf.sort_values(["key", "conv_id", "depth"], kind="stable")
    child: dict[tuple, int] = {}
    keys, parent, depth, least, n, children, words, end, up = [], [], [], [], [], [], [], [], []
    at, key, conv = -1, None, None
    for k, u, c, last, copies, d, a, b, w in zip(*(pdf[x].tolist() for x in ("key", "up", "conv_id", "n", "copies", "depth", "a", "b", "words"))):
        above = -1 if k != key or c != conv else at
        at = child.setdefault((above, a, b) if above >= 0 else k, len(keys))
        if at == len(keys):
            for column, x in ((keys, k), (parent, above), (depth, d), (least, c), (n, 0), (children, 0), (words, w), (end, None), (up, u)):
                column.append(x)
            if above >= 0:
                children[above] += 1
        n[at] += copies
        if d == last:
            end[at] = c
        key, conv = k, c
    leaves, saved = [0] * len(keys), [(m - 1) * w for m, w in zip(n, words)]
    for i in range(len(keys) - 1, -1, -1):  # postorder without recursion: a node's children have larger numbers
        leaves[i] += children[i] == 0
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = [least[p] if p >= 0 else u for p, u in zip(parent, up)]
    whole = lambda x: pd.array([None if pd.isna(v) else int(v) for v in x], "Int64")
    return pd.DataFrame({"key": keys, "root": [p < 0 for p in parent], "conv_id": least, "depth": depth, "parent_conv_id": whole(above), "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "end": whole(end)})


def _split(rows: DataFrame, at_root: bool, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, links, rest) of subtries that are too large: the nodes of each one's common run of turns, (key, child) of the
    subtries below, and their rows, from the turn after the run on. The root of all is a run of itself."""
    level = rows.groupBy("key", "depth").agg(
        F.count("*").alias("m"), F.sum("copies").alias("n_convs"), F.min("conv_id").alias("least"), F.max("words").alias("words"), F.min("up").alias("up"), F.max(F.when(F.col("n") == F.col("depth"), F.col("conv_id"))).alias("end"),
        ((F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))).alias("one"),
    )
    level = materialize(level, f"{name}-levels")
    top = level.groupBy("key").agg(F.min("depth").alias("top"), F.max("depth").alias("deepest"), F.max_by("m", -F.col("depth")).alias("members"), F.min("least").alias("first"))
    apart = level.join(top.select("key", "members"), "key").where("m < members or not one").groupBy("key").agg(F.min("depth").alias("apart"))
    run = F.lit(0) if at_root else F.coalesce(F.col("apart") - 1, F.col("deepest"))
    top = materialize(top.join(apart, "key", "left").select("key", "top", "first", run.cast("long").alias("run")), f"{name}-runs")
    runs = level.join(top, "key").where("depth <= run").select("key", "depth", "top", "run", "least", "up", "n_convs", "words", "end")
    rest = rows.join(top.select("key", "first", "run"), "key").where("depth > run")
    turn = rest.where("depth = run + 1").select("key", "conv_id", F.md5(F.concat_ws(":", "key", "a", "b").cast("binary")).alias("child"))
    turn = materialize(turn, f"{name}-next")
    rest = rest.drop("key", "up").join(turn.select("conv_id", "child"), "conv_id").withColumnsRenamed({"child": "key", "first": "up"}).select(rows.columns)
    return materialize(runs, f"{name}-nodes"), turn.select("key", "child").distinct(), materialize(rest, f"{name}-rest")


def _join_up(runs: DataFrame, links: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of runs, with what the subtries below (key, n_leaves, saved_tokens of their roots) add up to."""
    sums = links.join(below.withColumnRenamed("key", "child"), "child").groupBy("key").agg(F.count("*").alias("n_below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    own = F.sum((F.col("n_convs") - 1) * F.col("words")).over(Window.partitionBy("key").orderBy(F.desc("depth")))
    n = F.when(F.col("depth") < F.col("run"), F.lit(1)).otherwise(F.coalesce("n_below", F.lit(0)))
    return runs.join(sums, "key", "left").select(
        "key", (F.col("depth") == F.col("top")).alias("root"), F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("least")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs",
        n.cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "end",
    )


def trie(paths: DataFrame, conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, depth, a, b, words), with the hash of the ids that end at each."""
    x = paths.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("depth", "a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", "depth")).alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = materialize(conversations.join(x, "conv_id", "left").select("conv_id", zero("n"), zero("x"), zero("y")), "trie-whole")
    groups = materialize(whole.groupBy("n", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "trie-groups")
    reps = groups.select(F.col("rep").alias("conv_id"), "n", "copies")
    start = reps.select(F.lit("").alias("key"), F.lit(None).cast("long").alias("up"), "conv_id", "n", "copies", *(F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "words")))
    turns = paths.join(reps, "conv_id").select(F.lit("").alias("key"), F.lit(None).cast("long").alias("up"), "conv_id", "n", "copies", "depth", "a", "b", "words")
    active, found, rounds = materialize(start.unionByName(turns), "trie-rows"), [], []
    large = active
    while True:
        k = len(rounds)
        runs, links, rest = _split(large, k == 0, f"trie-{k}")
        rounds.append((runs, links))
        sizes = materialize(rest.groupBy("key").agg(F.count("*").alias("rows")), f"trie-{k}-sizes")
        over = sizes.where(F.col("rows") > most).select("key")
        total = sizes.where(F.col("rows") <= most).agg(F.sum("rows")).first()[0] or 0
        if total:
            few = rest.join(over, "key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(-(-total // most))))
            found.append(materialize(few.groupBy("bucket").applyInPandas(_forest, NODE), f"trie-{k}-forest"))
        if over.isEmpty():
            break
        large = materialize(rest.join(over, "key", "left_semi"), f"trie-{k}-large")
    nodes = found
    tops = lambda df: df.where("root").select("key", "n_leaves", "saved_tokens")
    for k in range(len(rounds) - 1, -1, -1):
        below = rounds[k][0].sparkSession.createDataFrame([], "key string, n_leaves long, saved_tokens long")
        for df in nodes:
            below = below.unionByName(tops(df))
        nodes = [*nodes, materialize(_join_up(*rounds[k], below), f"trie-{k}-up")]
    every = nodes[0]
    for df in nodes[1:]:
        every = every.unionByName(df)
    members = whole.join(groups.where("copies > 1"), ["n", "x", "y"]).select("rep", "conv_id")
    ends = groups.where("copies = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256")).unionByName(id_digests(members))
    return every.join(ends, F.col("end") == F.col("rep"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def op12_prefix_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    paths, every = rebuilt(conversations)
    return trie(paths, every, most)


OP12_SQL = f"""WITH RECURSIVE {CRC_SQL},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, struct_pack(d := sha256(coalesce(role, '') || chr(31) || coalesce(text, '')), w := len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS x FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, list(x ORDER BY k) AS turns FROM t GROUP BY c), h AS (SELECT c, turns, ({crc_sql('c::VARCHAR')} % 4)::INT AS h FROM n, crc),
p AS (SELECT a.c, list_concat(coalesce(b.turns, []::STRUCT(d VARCHAR, w BIGINT)[])[1:a.h], a.turns[a.h + 1:]) AS path FROM h a LEFT JOIN n b ON b.c = a.c - a.c % {BLOCK}),
d AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
node AS (SELECT path[1:depth] AS pre, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = depth), '')) AS ends_sha256 FROM d GROUP BY ALL),
kids AS (SELECT pre[1:depth - 1] AS pre, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n, 0) AS n_children, (n_convs - 1) * CASE WHEN node.depth = 0 THEN 0 ELSE node.pre[node.depth].w END AS own FROM node LEFT JOIN kids USING (pre, depth)),
below AS (SELECT pre[1:a.at] AS pre, a.at AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS at FROM full_) a GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (pre, depth) LEFT JOIN node u ON u.depth = f.depth - 1 AND u.pre = f.pre[1:f.depth - 1]"""
