"""Conversations as a trie of their turns, with totals of every subtree by centroid decomposition.

A node is a distinct sequence of first turns, named by its smallest member and its depth. Members, children and the
turns of all members below a node follow from grouping; the last is a node's weight, as every node below weighs as many
turns as it has members. Totals over distinct nodes are rolled up by decomposing the forest of parent edges: the
centroid of a component is its deepest node with at least half of the weight, so removing it leaves components of at
most half the weight each. The total of the centroid's part, the sum of what hangs on it, is added to every node on the
path from the centroid to the component's top, whose own totals then come from smaller components. A logarithmic number
of levels ends it, however long or bushy the trie is.

Components heavier than ``task_turns`` are decomposed level by level over the whole table; lighter ones fit a task and
end there by the same recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import join_counted, table
from barloom.session import cut_lineage

#: Components of at most so many turns are decomposed within a task.
TASK_TURNS = 1 << 16
#: Ends of one node are hashed in pieces of so many numbers.
PIECE = 4096
#: Most turns that another conversation lends, and conversations that borrow from one.
MOST_LENT, BORROWERS = 5, 100
NODE = ["conv_id", "depth"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (hashes of role and text) and chars of every turn.

    Turns with a null number come first; rows that share one follow the hashes, so repeats stay side by side. Null roles
    and texts are empty; rows without a conv_id belong to no conversation.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), text, role).alias("k2"), F.char_length(text).cast("long").alias("chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "k1", "k2")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "k1", "k2", "chars")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all conv_ids, turns of the rebuilt conversations): the first h of conversation c - c % 100, then own ones after h."""
    h = F.crc32(F.col("conv_id").cast("string")) % (MOST_LENT + 1)
    own = turns.withColumn("h", h)
    convs = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BORROWERS).alias("lender"))
    lent = turns.where((F.col("pos") <= MOST_LENT) & (F.col("conv_id") % BORROWERS == 0)).withColumnRenamed("conv_id", "lender")
    first = convs.join(lent, "lender").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "k1", "k2", "chars")
    rest = own.where("pos > h").select("conv_id", F.lit(1).alias("part"), "pos", "k1", "k2", "chars")
    return convs.select("conv_id"), first.unionByName(rest)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its depth, the two hashes of all turns up to it, and the conversation's turns from it on."""
    run = Window.partitionBy("conv_id").orderBy("part", "pos")
    placed = turns.withColumn("depth", F.row_number().over(run).cast("long"))
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    left = F.count(F.lit(1)).over(Window.partitionBy("conv_id")) - F.col("depth") + 1
    # turns are salted by their depth, so that the exclusive or of their hashes names the sequence
    return placed.select(
        "conv_id", "depth", "chars", left.alias("left"),
        F.bit_xor(F.xxhash64("depth", "k1", "k2")).over(upto).alias("p1"), F.bit_xor(F.xxhash64("k2", "depth", "k1")).over(upto).alias("p2"),
    )


def _nodes(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes but the root, steps): a node has parent_conv, n_convs, weight and chars; a step is the node of a conversation at a depth."""
    prefixes = cut_lineage(prefixes)
    key = ["depth", "p1", "p2"]
    named = cut_lineage(prefixes.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum("left").alias("weight")))
    met = join_counted(prefixes, named.withColumn("rows", F.col("n_convs")), key, "rows", prefixes.count())
    root = F.lit(None).cast("long")
    back = F.lag("node").over(Window.partitionBy("conv_id").orderBy("depth"))
    steps = cut_lineage(met.select("conv_id", "depth", "node", "n_convs", "weight", "chars", F.coalesce(back, root).alias("parent_conv")))
    own = steps.where("node = conv_id").select("conv_id", "depth", "parent_conv", "n_convs", "weight", "chars")
    return own, steps.select("conv_id", "depth", "node", "parent_conv")


def _split_wide(open_: DataFrame, steps: DataFrame, sums: list[str]) -> DataFrame:
    """One level of the decomposition of every component in ``open_``, whose rows carry their component's weight."""
    top = ["top_conv", "top_depth"]
    # the deepest node with half of the weight: such nodes are one path, and weights fall along it
    heavy = open_.where(F.col("weight") * 2 >= F.col("top_weight"))
    centroids = cut_lineage(heavy.groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c")))
    centroids = centroids.select(*top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
    # components are heavier than a task, so they are few
    rows = open_.join(F.broadcast(centroids), top)
    below = F.col("depth") > F.col("c_depth")
    at = steps.select(F.col("conv_id").alias("s_conv"), F.col("depth").alias("s_depth"), F.col("node").alias("child_conv"), F.col("parent_conv").alias("s_parent"))
    rows = rows.withColumn("look", F.when(below, F.col("c_depth") + 1)).join(at, (F.col("conv_id") == F.col("s_conv")) & (F.col("look") == F.col("s_depth")), "left")
    is_centroid = F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    # the root is every depth-1 node's parent and has no conversation of its own
    under = below & F.col("child_conv").isNotNull() & F.when(F.col("c_depth") == 0, True).otherwise(F.col("s_parent") == F.col("c_conv"))
    rows = cut_lineage(rows.withColumn("side", F.when(is_centroid, 1).when(F.coalesce(under, F.lit(False)), 2).otherwise(0)))
    # what hangs on the centroid, summed by component
    totals = cut_lineage(rows.where("side > 0").groupBy(*top).agg(*[F.sum(f"own_{s}").alias(f"t_{s}") for s in sums]))
    # the path from the centroid to the top of its component: the steps of the centroid's conversation
    path = centroids.where("c_depth > top_depth").select(*top, F.col("c_conv").alias("conv_id"), "c_depth", "c_weight").join(steps, "conv_id")
    path = path.where("depth >= top_depth and depth < c_depth").select(*top, F.col("node").alias("conv_id"), "depth", "c_weight")
    roots = centroids.where("c_depth > 0 and top_depth = 0").select(*top, F.col("top_conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c_weight")
    path = path.unionByName(roots).join(F.broadcast(totals), top).select("conv_id", "depth", F.col("c_weight").alias("less"), *[f"t_{s}" for s in sums])
    done = rows.where("side = 1").join(F.broadcast(totals), top)
    done = done.select(*NODE, *[(F.col(f"add_{s}") + F.col(f"t_{s}")).alias(s) for s in sums])
    low = rows.where("side = 2").select(*[c for c in open_.columns if c not in (*top, "top_weight")], F.col("child_conv").alias("top_conv"), (F.col("c_depth") + 1).alias("top_depth"))
    high = rows.where("side = 0").join(path, NODE, "left")
    high = high.select(
        *NODE, "parent_conv", *[f"own_{s}" for s in sums], *[(F.col(f"add_{s}") + F.coalesce(f"t_{s}", F.lit(0))).alias(f"add_{s}") for s in sums],
        (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), *top,
    )
    rest = cut_lineage(high.unionByName(low))
    weights = rest.groupBy(*top).agg(F.max("weight").alias("top_weight"))
    # a component's rows never exceed its weight, so the weights join like counted keys
    again = join_counted(rest, weights.withColumn("rows", F.col("top_weight")), top, "rows", max(1, rest.count()))
    return done, again


def decompose(component: np.ndarray, parent: np.ndarray, weight: np.ndarray, own: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Subtree sums of small components, each at most a task's: the same recursion, all components a level at once.

    ``parent`` is the row of the parent or -1 at a top; ``own`` and ``add`` have a column for every sum.
    """
    n = len(parent)
    label, weight, out = component.copy(), weight.astype(np.int64).copy(), add.astype(np.int64).copy()
    alive = np.ones(n, bool)
    depth = np.zeros(n, np.int64)
    jump = np.where(parent < 0, np.arange(n), parent)
    steps = (parent >= 0).astype(np.int64)
    while (jump[jump] != jump).any():
        steps, jump = steps + steps[jump], jump[jump]
    depth = steps
    while alive.any():
        live = np.flatnonzero(alive)
        _, at = np.unique(label[live], return_inverse=True)
        top = np.zeros(at.max() + 1, np.int64)
        np.maximum.at(top, at, weight[live])
        heavy = weight[live] * 2 >= top[at]
        order = np.lexsort((depth[live[heavy]], at[heavy]))
        last = np.flatnonzero(np.diff(at[heavy][order], append=-1))
        centroid = live[heavy][order][last]  # the deepest heavy row of component 0, 1, ...
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        # every row finds the nearest row above it that is a centroid's child, a centroid, or its component's top
        up = np.arange(n)
        inside = alive & (parent >= 0) & ~is_centroid
        same = np.zeros(n, bool)
        same[inside] = alive[parent[inside]] & (label[parent[inside]] == label[np.flatnonzero(inside)]) & ~is_centroid[parent[inside]]
        up[same] = parent[same]
        while (up[up] != up).any():
            up = up[up]
        # totals of the parts, and of what hangs on each centroid
        part = np.zeros_like(own)
        np.add.at(part, up[live], own[live])
        hangs = alive & (up == np.arange(n)) & (parent >= 0) & ~is_centroid
        hangs[hangs] &= is_centroid[parent[hangs]] & (label[parent[hangs]] == label[np.flatnonzero(hangs)])
        total = own[centroid].copy()
        rank = np.zeros(n, np.int64)
        rank[centroid] = np.arange(len(centroid))
        np.add.at(total, rank[parent[hangs]], part[hangs])
        out[centroid] += total
        less = weight[centroid]
        # along the paths to the tops
        here = centroid
        while len(here):
            above = parent[here]
            on = above >= 0
            on[on] = alive[above[on]] & (label[above[on]] == label[here[on]])
            here, total, less = above[on], total[on], less[on]
            out[here] += total
            weight[here] -= less
        alive[centroid] = False
        label = np.where(alive, up, label)
        # rows left in the upper part keep a label of their own: that of its top
    return out


def _local(sums: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        tops = pd.MultiIndex.from_arrays([rows["top_conv"], rows["top_depth"]])
        component = pd.factorize(tops)[0].astype(np.int64)
        index = pd.Series(np.arange(n), index=pd.MultiIndex.from_arrays([rows["conv_id"], rows["depth"]]))
        is_top = (rows["conv_id"] == rows["top_conv"]) & (rows["depth"] == rows["top_depth"])
        parent = np.full(n, -1, np.int64)
        rest = np.flatnonzero(~is_top.to_numpy())
        if len(rest):
            above = pd.MultiIndex.from_arrays([rows["parent_conv"].to_numpy()[rest], rows["depth"].to_numpy()[rest] - 1])
            parent[rest] = index.reindex(above).to_numpy(np.float64).astype(np.int64)
        own, add = (rows[[f"{kind}_{s}" for s in sums]].to_numpy(np.int64) for kind in ("own", "add"))
        out = decompose(component, parent, rows["weight"].to_numpy(), own, add)
        return pd.DataFrame({"conv_id": rows["conv_id"], "depth": rows["depth"], **{s: out[:, i] for i, s in enumerate(sums)}})

    return run


def subtree_sums(nodes: DataFrame, steps: DataFrame, sums: list[str], task_turns: int = TASK_TURNS) -> DataFrame:
    """conv_id, depth and, for each of ``sums``, the total of its column ``own_*`` over the node's subtree.

    ``nodes`` needs conv_id, depth, parent_conv, weight (of the subtree) and the own values; the root has depth 0.
    """
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv"), F.col("weight").alias("top_weight"))
    found = root.first()
    if found is None:
        return nodes.select(*NODE, *[F.col(f"own_{s}").alias(s) for s in sums])
    spark = nodes.sparkSession
    rows = nodes.select(
        *NODE, "parent_conv", *[F.col(f"own_{s}").cast("long").alias(f"own_{s}") for s in sums], *[F.lit(0).cast("long").alias(f"add_{s}") for s in sums], F.col("weight").cast("long").alias("weight"),
        F.lit(found["top_conv"]).cast("long").alias("top_conv"), F.lit(0).cast("long").alias("top_depth"), F.lit(found["top_weight"]).cast("long").alias("top_weight"),
    )
    total = found["top_weight"]
    finished, small = [], []
    while True:
        small.append(rows.where(F.col("top_weight") <= task_turns))
        wide = rows.where(F.col("top_weight") > task_turns)
        if wide.isEmpty():
            break
        done, rows = _split_wide(wide, steps, sums)
        rows = cut_lineage(rows)
        finished.append(done)
    light = small[0]
    for x in small[1:]:
        light = light.unionByName(x)
    buckets = max(1, -(-4 * total // max(1, task_turns)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "conv_id long, depth long, " + ", ".join(f"{s} long" for s in sums)
    bucket = F.pmod(F.xxhash64("top_conv", "top_depth"), F.lit(buckets))
    out = light.groupBy(bucket.alias("bucket")).applyInPandas(_local(sums), schema)
    for x in finished:
        out = out.unionByName(x)
    return out


def _end_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of every node's ends from pieces in order; a node's pieces follow each other."""
    now, digest, first = None, None, True

    def told(node):
        return pd.DataFrame({"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]})

    for rows in batches:
        out = []
        for conv, depth, listed in zip(rows["conv_id"], rows["depth"], rows["listed"], strict=True):
            if (conv, depth) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest, first = (conv, depth), hashlib.sha256(), True
            digest.update((listed if first else "," + listed).encode())
            first = False
        yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
    if now is not None:
        yield told(now)


def _ends(ends: DataFrame) -> DataFrame:
    """conv_id and depth of nodes where conversations (``member``) end, and the hash of their numbers."""
    piece = F.floor(F.col("member") / PIECE)
    pieces = ends.groupBy(*NODE, piece.alias("piece")).agg(F.sort_array(F.collect_list("member")).alias("m"))  # PIECE numbers at most
    pieces = pieces.select(*NODE, "piece", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("listed"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInPandas(_end_hashes, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, with members, children, and totals of their subtrees.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, as the contract has them. Turns are ordered by number, null first; rows that share one by hashes of
    role and text. Null roles and texts are empty. Rows with a null conv_id belong to no conversation; a table without
    any other gives no rows, not even a root. Other columns are ignored.
    """
    convs, turns = rebuilt_turns(cut_lineage(ordered_turns(conversations)))
    convs = cut_lineage(convs)
    nodes, steps = _nodes(_prefixes(turns))
    facts = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    turns_all = nodes.where("depth = 1").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    null = F.lit(None).cast("long")
    root = facts.where("n_convs > 0").crossJoin(turns_all)  # one row each
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), null.alias("parent_conv"), "n_convs", (F.col("w") + F.col("n_convs")).alias("weight"), F.lit(0).cast("long").alias("chars"))
    first = root.first()
    if first is None:
        return root.select("conv_id", "depth", null.alias("parent_conv_id"), "n_convs", null.alias("n_children"), null.alias("n_leaves"), null.alias("saved_tokens"), F.lit("").alias("ends_sha256"))
    least = F.lit(first["conv_id"]).cast("long")
    nodes = nodes.unionByName(root).withColumn("parent_conv", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv")))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.withColumns({"own_n_leaves": (F.col("n_children") == 0).cast("long"), "own_saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    sums = subtree_sums(own, steps, ["n_leaves", "saved_tokens"], task_turns)
    last = steps.groupBy(F.col("conv_id").alias("member")).agg(F.max(F.struct("depth", "node")).alias("e"))
    ends = convs.join(last, F.col("conv_id") == F.col("member"), "left").select(F.coalesce("e.node", least).alias("conv_id"), F.coalesce("e.depth", F.lit(0)).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    return nodes.join(sums, NODE).join(_ends(ends), NODE, "left").select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    )


def op12_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: crc32 of a text of ASCII characters, as DuckDB has none: one step for each byte and eight for its bits.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split({0}, ''),
  lambda ch: list_concat([ascii(ch)::UBIGINT], list_transform(range(8), lambda i: 999::UBIGINT))))),
  lambda c, x: CASE WHEN x < 999 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT)"""

OP12_SQL = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {CRC32_SQL.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
steps AS (SELECT conv_id, row_number() OVER o AS depth, list(role || chr(1) || text) OVER o AS path, length(text) AS chars FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)),
prefixes AS (SELECT conv_id, depth, path, chars FROM steps UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY path) AS node FROM prefixes),
nodes AS (SELECT node, depth, path, count(*) AS n_convs, any_value(chars) AS chars FROM named GROUP BY node, depth, path),
parents AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM parents WHERE parent IS NOT NULL GROUP BY ALL),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM named n
  WHERE depth = (SELECT max(depth) FROM prefixes p WHERE p.conv_id = n.conv_id) GROUP BY path),
below AS (
  SELECT a.node, a.depth, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[:a.depth] = a.path
  LEFT JOIN kids k ON k.parent = b.node AND k.depth = b.depth
  GROUP BY a.node, a.depth)
SELECT p.node AS conv_id, p.depth, p.parent AS parent_conv_id, p.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM parents p JOIN below b ON b.node = p.node AND b.depth = p.depth
LEFT JOIN kids k ON k.parent = p.node AND k.depth = p.depth
LEFT JOIN ends e ON e.path = p.path
"""
