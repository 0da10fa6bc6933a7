"""A trie of conversations by partition refinement.

All conversations start in one class; a round splits the classes that are still
shared by the next turns, retires conversations that are alone, and writes what
is left.  A retired one adds its tail as an unary chain, without more rounds.
What is counted below a node is then folded back: each conversation adds what
it stands for, from its end on, to each class it was in.

A round takes as many turns as all rounds before it together (BLOCK at most),
so a prefix of n shared turns takes about log n rounds.  Turns are compared by
SHA-256; texts are read once.  Only rows of one conversation and round meet in
a group; a class as large as a third of all is counted before it is shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import drop_written, written

#: Turns that a round takes at most: keys of 32 bytes in one row.
BLOCK = 4096
#: Members of a node in a row that is hashed.
CHUNK = 1000
#: Turns that a conversation of the tests' rule may take from another, and the conversations that share one.
HEADS, FAMILY = 6, 100


def _numbered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, k, key, size), written: turns with their place from 1, a digest of role and text, and the text's code points. No task sorts a conversation."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = conversations.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = ["conv", "turn", "role", "text"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.select("conv", key.alias("key"), F.length("text").cast("bigint").alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # a row for each conversation and part
    parts = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    places = parts.select(F.col("conv").alias("of"), F.col("part").alias("in"), (before - F.col("first") + 1).alias("shift"))
    out = written(rows.join(places, (F.col("conv") == F.col("of")) & (F.col("part") == F.col("in"))).select("conv", (F.col("at") + F.col("shift")).alias("k"), "key", "size"))
    drop_written(rows)
    return out


def own_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv, depth, key, size), (conv, length)): the conversations as they are, both written."""
    turns = _numbered(conversations, conv, turn, role, text)
    return turns.withColumnRenamed("k", "depth"), written(turns.groupBy("conv").agg(F.max("k").alias("length")))


def rebuilt_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """As own_turns, each conversation c rebuilt: the first h turns of c - c mod FAMILY (at or below c; fewer or none if it has no more), then its own after its first h; h is the CRC-32 of c's digits modulo HEADS."""
    turns = _numbered(conversations, conv, turn, role, text)
    sizes = turns.groupBy("conv").agg(F.max("k").alias("n")).withColumn("h", F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % HEADS)
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("k") < HEADS)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("k", "key", "size"))).alias("head"))
    info = sizes.join(heads, F.col("conv") - F.pmod("conv", F.lit(FAMILY)) == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    info = written(info.select("conv", "n", "h", head.alias("head")))
    taken = F.size("head").cast("bigint")
    front = info.select("conv", F.explode("head").alias("t")).select("conv", F.col("t")["k"].alias("depth"), F.col("t")["key"].alias("key"), F.col("t")["size"].alias("size"))
    shifts = info.where("n > h").select(F.col("conv").alias("of"), "h", (taken - F.col("h")).alias("shift"))
    rest = turns.join(shifts, (F.col("conv") == F.col("of")) & (F.col("k") > F.col("h"))).select("conv", (F.col("k") + F.col("shift")).alias("depth"), "key", "size")
    out = written(front.unionByName(rest))
    lengths = written(info.select("conv", (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    drop_written(turns, info)
    return out, lengths


def _chained(keys: Column) -> Column:
    """Of a list of (depth, key, size): each with the digest of all keys up to it."""
    none = F.array().cast("array<struct<depth:bigint,chain:binary,size:bigint>>")

    def step(done: Column, t: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1)["chain"], F.lit(b""))
        chain = F.unhex(F.sha2(F.concat(last, t["key"]), 256))
        return F.concat(done, F.array(F.struct(t["depth"].alias("depth"), chain.alias("chain"), t["size"].alias("size"))))

    return F.aggregate(keys, none, step)


def refine(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, node, n, size, length), written: for each conversation and depth the class it is in, named by its smallest member, while it is shared, and the first one in which it is alone.

    depth 0 is the class of all.  turns: (conv, depth, key, size), lengths:
    (conv, length), as tables.
    """
    every = lengths.agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"))  # one row
    kinds = "conv bigint, depth bigint, node bigint, n bigint, size bigint, length bigint"
    first, n = every.first()
    rounds = [written(lengths.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(first).cast("bigint").alias("node"), F.lit(n).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("size"), "length"))]
    at = 0
    while n:
        to = at + max(1, min(at, block))
        active = rounds[-1].where((F.col("depth") == at) & ((F.col("n") > 1) | (F.col("depth") == 0)) & (F.col("length") > at)).select(F.col("conv").alias("of"), F.col("node").alias("class"), "length")
        if active.isEmpty():
            break
        following = turns.where((F.col("depth") > at) & (F.col("depth") <= to)).join(active, F.col("conv") == F.col("of"))
        if to == at + 1:
            cells = following.select("conv", "class", "length", "depth", F.col("key").alias("chain"), "size")
        else:  # `to - at` turns of a conversation meet here at most
            lists = following.groupBy("conv", "class", "length").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "size"))).alias("keys"))
            cells = lists.select("conv", "class", "length", F.explode(_chained(F.col("keys"))).alias("t")).select("conv", "class", "length", "t.depth", "t.chain", "t.size")
        cells = written(cells)
        split = cells.groupBy("class", "depth", "chain").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"))
        own = cells.join(split, ["class", "depth", "chain"]).select("conv", "depth", "node", "n", "size", "length")
        rounds.append(written(own))
        drop_written(cells)
        at = to
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    alone = F.min(F.when((F.col("n") == 1) & (F.col("depth") > 0), F.col("depth"))).over(Window.partitionBy("conv"))
    kept = written(out.withColumn("alone", alone).where((F.col("n") > 1) | (F.col("depth") == F.col("alone")) | (F.col("depth") == 0)).drop("alone")) if n else written(turns.sparkSession.createDataFrame([], kinds))
    drop_written(*rounds)
    return kept


def _joined_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv) rows: the digest of a node's members in ascending order, joined by commas.

    Members are packed into chunks in sorted ranges; the digest, a chain by its
    nature, reads a node's chunks one after the other and holds one of them.
    """

    def pack(batches):
        now, own = None, []

        def chunk():
            return pa.record_batch({"depth": pa.array([now[0]]), "node": pa.array([now[1]]), "first": pa.array([own[0]]), "ids": pa.array([",".join(map(str, own))])})

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and ((depth, node) != now or len(own) >= CHUNK):
                    yield chunk()
                    own = []
                now = depth, node
                own.append(conv)
        if own:
            yield chunk()

    def digest(batches):
        now, sha = None, None
        row = lambda: pa.record_batch({"depth": pa.array([now[0]]), "node": pa.array([now[1]]), "ends_sha256": pa.array([sha.hexdigest()])})
        for batch in batches:
            for depth, node, ids in zip(*(batch[c].to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) != now:
                    if now:
                        yield row()
                    now, sha = (depth, node), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if now:
            yield row()

    order = ["depth", "node", "conv"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "depth bigint, node bigint, first bigint, ids string")
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth bigint, node bigint, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct beginning of the conversations, as own_turns() or rebuilt_turns() give them.

    A node is named by the smallest conversation that begins so, and its depth
    in turns; the root has depth 0.  saved_tokens: over the node's subtree, the
    code points of each node's last text, as often as others share it.
    ends_sha256: of the conversations that end at the node (none: of an empty
    text).  No conversations have no root.  Equal conversations, and those
    without turns, count each.
    """
    classes = refine(turns, lengths, block)
    rep = F.col("conv") == F.col("node")
    down = Window.partitionBy("conv").orderBy(F.desc("depth"))
    shared = (F.col("n") > 1) | (F.col("depth") == 0)
    # what a conversation stands for, from each depth on: the nodes named by it
    own = F.when(rep & shared, (F.col("n") - 1) * F.col("size")).otherwise(0)
    folded = classes.withColumns(
        {
            "below": F.sum(own).over(down),
            "child": F.coalesce(F.lag(rep.cast("bigint")).over(down), F.lit(0)),
            "up": F.lead("node").over(down),
            "shared": shared,
        }
    )
    alone = written(folded.where(~F.col("shared")).select(F.col("conv").alias("of"), F.col("depth").alias("from"), "up"))
    # a childless shared node ends all of its members; of those alone each has one
    nodes = written(
        folded.where("shared").join(alone.select("of", F.lit(1).cast("bigint").alias("tail")), F.col("conv") == F.col("of"), "left").select(
            "depth", "node", "conv", "below", "child", F.coalesce("tail", F.lit(0)).alias("tail"), "up", (F.col("length") == F.col("depth")).alias("ends")
        )
    )
    ends = nodes.where("ends").groupBy("depth", "node").agg(F.count(F.lit(1)).alias("ended"))
    sizes = nodes.groupBy("depth", "node").agg(F.count(F.lit(1)).alias("n"))
    full = sizes.join(ends, ["depth", "node"]).where("n = ended").select(F.col("depth").alias("leaf_depth"), F.col("node").alias("leaf"), F.lit(1).cast("bigint").alias("stop"))
    # the conversation that names a childless shared node counts as its leaf in all classes it was in
    both = nodes.join(full.select("leaf", "stop"), F.col("conv") == F.col("leaf"), "left")
    counts = both.groupBy("depth", "node").agg(
        F.min(F.when(F.col("conv") == F.col("node"), F.col("up"))).alias("parent"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum(F.col("tail") + F.coalesce("stop", F.lit(0))).alias("n_leaves"),
        F.sum("below").alias("saved_tokens"),
    )
    hashes = _joined_digests(nodes.where("ends").select("depth", "node", "conv")).select(F.col("depth").alias("d"), F.col("node").alias("m"), "ends_sha256")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    inner = counts.join(hashes, (F.col("depth") == F.col("d")) & (F.col("node") == F.col("m")), "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )
    tails = turns.join(alone.join(lengths.select(F.col("conv").alias("owner"), "length"), F.col("of") == F.col("owner")), F.col("conv") == F.col("of")).where(F.col("depth") >= F.col("from"))
    final = F.col("depth") == F.col("length")
    one = F.lit(1).cast("bigint")
    chains = tails.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("from"), F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(final, 0).otherwise(1).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(final, F.sha2(F.encode(F.col("conv").cast("string"), "UTF-8"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return inner.unionByName(chains)
