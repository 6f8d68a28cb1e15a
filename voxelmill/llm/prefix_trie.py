"""The trie of all conversation prefixes, by ROLLUP over turn columns.

A turn becomes an id of 24 bytes: a digest of role and text, and the number of words of the text. A
conversation becomes rows of ``width`` turn columns, one for each block of turns; a block is keyed by the
node in which the block before it ends, which is named by its depth and two 64-bit sums over the turns above
it. One ROLLUP over the columns of all blocks then counts every prefix of every conversation at once, however
long conversations are. What subtrees sum up is rolled up the same way: each node is counted for
its smallest member, and a conversation hands on what is counted for it in its block and later ones.

Turns are ordered in slices of one conversation, so that a very long one is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm.common import bound_batches, materialize

SLICE_TURNS = 256
ENDS_SLICE = 1 << 14


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv, turn, tid) of all rows that have a conversation id; null roles and texts are empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    tid = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(words.cast("long")), 16, "0")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), tid.alias("tid")).where("conv is not null")


def words_of(tid: Column) -> Column:
    return F.conv(F.hex(F.substring(tid, 17, 8)), 16, 10).cast("long")


def sliced(turns: DataFrame) -> DataFrame:
    """Slices of a conversation that follow its order: ranges of turn numbers, and for turns without
    number, which come first, ranges of turn ids."""
    first = F.conv(F.hex(F.substring("tid", 1, 1)), 16, 10).cast("long")
    return turns.withColumn("slice", F.when(F.col("turn").isNull(), F.struct(F.lit(-1 << 62).alias("a"), first.alias("b"))).otherwise(
        F.struct(F.floor(F.col("turn") / SLICE_TURNS).alias("a"), F.lit(0).cast("long").alias("b"))))


def with_shared_heads(turns: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """(conv, pos, tid) of rebuilt conversations: the first h turns of conversation c - c % every, then c's own
    turns after its first h, with h = CRC-32 of the decimal c, modulo ``kinds``.

    Turns are ordered by number, null first, those of one number by turn id. Every conversation has a row at
    position 0 without a turn, so that one without turns is kept. ``kinds`` = 1 changes nothing.
    """
    order = [F.asc_nulls_first("turn"), F.asc("tid")]
    convs = turns.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string")) % kinds)
    heads = (
        turns.where(F.col("conv") % every == 0).withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
        .where(F.col("pos") < kinds).select(F.col("conv").alias("base"), F.col("pos").cast("long").alias("pos"), "tid"))
    lent = convs.withColumn("base", F.col("conv") - F.col("conv") % every).join(heads, "base").where("pos <= h").select("conv", "pos", "tid")
    rows = sliced(turns)
    sizes = rows.groupBy("conv", "slice").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = convs.join(lent.groupBy("conv").agg(F.count("*").alias("taken")), "conv", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    sizes = sizes.join(taken, "conv").drop("n")
    own = (
        rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv", "slice").orderBy(*order))).join(sizes, ["conv", "slice"])
        .withColumn("pos", F.col("pos") + F.col("before")).where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid"))
    marks = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"))
    return own.unionByName(lent).unionByName(marks)


def step(position: Column, tid: Column, salt: int) -> Column:
    """What a turn at a place adds to the name of the node below it."""
    return F.when(tid.isNotNull(), F.xxhash64(F.lit(salt), position, tid)).otherwise(F.lit(0).cast("long"))


def turn_blocks(turns: DataFrame, width: int) -> DataFrame:
    """One row for each block of ``width`` turns: (conv, slice, blk, t1.., n, k1, k2, final). k1 and k2 name the node
    that the block starts from, ``final`` says that no block follows."""
    slot = F.col("pos") - 1 - F.col("blk") * width
    placed = turns.withColumn("blk", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / width))
    placed = placed.withColumn("slice", F.floor(F.col("blk") / SLICE_TURNS)).repartition("conv", "slice")
    blocks = placed.groupBy("conv", "slice", "blk").agg(
        F.count("tid").alias("n"), *[F.max(F.when(slot == j, F.col("tid"))).alias(f"t{j + 1}") for j in range(width)],
        *[F.bit_xor(step(F.col("pos"), F.col("tid"), salt)).alias(f"x{salt}") for salt in (1, 2)])
    above = Window.partitionBy("conv", "slice").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("conv", "slice").orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    inner = blocks.select("*", *[F.coalesce(F.bit_xor(f"x{s}").over(above), zero).alias(f"y{s}") for s in (1, 2)], F.count("*").over(below).alias("after"))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("conv", "slice").agg(*[F.bit_xor(f"x{s}").alias(f"x{s}") for s in (1, 2)])
    totals = totals.select(
        "conv", "slice", *[F.coalesce(F.bit_xor(f"x{s}").over(earlier), zero).alias(f"z{s}") for s in (1, 2)],
        F.lead("slice").over(Window.partitionBy("conv").orderBy("slice")).isNotNull().alias("more"))
    return inner.join(totals, ["conv", "slice"]).select(
        "conv", "slice", "blk", "n", *[f"t{j + 1}" for j in range(width)],
        *[F.col(f"y{s}").bitwiseXOR(F.col(f"z{s}")).alias(f"k{s}") for s in (1, 2)], ((F.col("after") == 0) & ~F.col("more")).alias("final"))


def rolled(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """ROLLUP over the turn columns of all blocks: the ``sums`` of every node, with the node's name (depth, k1, k2),
    its parent's (p1, p2) and its last turn."""
    columns = ", ".join(f"t{j + 1}" for j in range(width))
    nodes = blocks.sparkSession.sql(
        f"SELECT blk, k1, k2, {columns}, {width} - bit_count(grouping_id()) AS level, {sums} FROM {{blocks}} GROUP BY blk, k1, k2, ROLLUP({columns})", blocks=blocks)
    level, last = F.col("level"), F.coalesce(*[F.when(F.col("level") == j + 1, F.col(f"t{j + 1}")) for j in range(width)])
    # A level whose last column is empty repeats a shorter prefix; level 0 is the last node of the block before.
    nodes = nodes.withColumn("last", last).where("(level = 0 AND blk = 0) OR last IS NOT NULL")
    start = F.col("blk") * width

    def name(salt: int, to: Column) -> Column:
        out = F.col(f"k{salt}")
        for j in range(width):
            out = out.bitwiseXOR(F.when(to > j, step(start + j + 1, F.col(f"t{j + 1}"), salt)).otherwise(F.lit(0).cast("long")))
        return out

    keep = [c for c in nodes.columns if c not in {"k1", "k2", "level", "last", *columns.split(", ")}]
    return nodes.select(*keep, (start + level).alias("depth"), "last", *[name(s, level).alias(f"k{s}") for s in (1, 2)], *[name(s, level - 1).alias(f"p{s}") for s in (1, 2)])


@dataclass
class Trie:
    """``nodes`` (depth, k1, k2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and ``ends`` (depth,
    k1, k2, slice, convs): the conversations that end in a node, ascending, in slices that rise."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(turns: DataFrame, width: int = 8) -> Trie:
    """All prefixes of conversations, given as (conv, pos, tid) with a row at position 0 for each.

    A node's ``conv_id`` is its smallest member; ``saved_tokens`` sums over its subtree the words of each
    node's last turn times its members less one. The root (depth 0) has no turn and no parent. Without any
    conversation there is no node.
    """
    blocks = materialize(turn_blocks(turns, width), "trie-blocks")
    nodes = materialize(rolled(blocks, width, "count(*) AS n_convs, min(conv) AS conv"), "trie-nodes")
    name = ["depth", "k1", "k2"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, name, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce(words_of(F.col("last")), F.lit(0)))
    # Saved words counted for the smallest member above this node in its block, which are not of its subtree.
    higher = Window.partitionBy("conv", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    known = materialize(known.withColumn("higher", F.coalesce(F.sum("saved").over(higher), F.lit(0))), "trie-known")
    counted = known.groupBy("conv", "blk").agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    own = blocks.join(counted, ["conv", "blk"], "left")
    following = Window.partitionBy("conv", "slice").orderBy("blk").rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy("conv").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    rest = own.groupBy("conv", "slice").agg(F.sum("saved").alias("saved"), F.max("leaf").alias("leaf"))
    rest = rest.select("conv", "slice", F.sum("saved").over(later).alias("saved_later"), F.max("leaf").over(later).alias("leaf_later"))
    handed = own.withColumn("saved", F.sum("saved").over(following)).withColumn("leaf", F.max("leaf").over(following)).join(rest, ["conv", "slice"])
    zero = F.lit(0).cast("long")
    handed = handed.withColumn("saved", F.coalesce("saved", zero) + F.coalesce("saved_later", zero)).withColumn("leaf", F.greatest(F.coalesce("leaf", zero), F.coalesce("leaf_later", zero)))
    below = rolled(handed, width, "sum(saved) AS saved_below, sum(leaf) AS n_leaves").select(*name, "saved_below", "n_leaves")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    done = known.join(below, name).join(parents, ["depth", "p1", "p2"], "left").select(
        *name, F.col("conv").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("saved_below") - F.col("higher")).alias("saved_tokens"))
    depth = F.col("blk") * width + F.col("n")
    places = [F.when(F.col("n") > j, step(F.col("blk") * width + j + 1, F.col(f"t{j + 1}"), s)).otherwise(zero) for s in (1, 2) for j in range(width)]
    names = [F.col(f"k{s}") for s in (1, 2)]
    for j in range(width):
        names = [names[0].bitwiseXOR(places[j]), names[1].bitwiseXOR(places[width + j])]
    ends = blocks.where("final").select(depth.alias("depth"), names[0].alias("k1"), names[1].alias("k2"), "conv")
    ends = ends.groupBy(*name, F.floor(F.col("conv") / ENDS_SLICE).alias("slice")).agg(F.sort_array(F.collect_list("conv")).alias("convs"))
    return Trie(done, ends)


def ends_digest(trie: Trie) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes in which conversations end: the lowercase SHA-256 of their decimal ids,
    ascending and joined by commas. The digest of a node is one chain by nature: a task reads the node's slices
    one after the other, each at most ``ENDS_SLICE`` ids."""
    import hashlib

    import pyarrow as pa

    spark = trie.ends.sparkSession
    bound_batches(spark)
    schema = "depth long, k1 long, k2 long, ends_sha256 string"

    def run(batches):
        now, chain, rows = None, None, []
        for batch in batches:
            for depth, k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")]):
                if now == (depth, k1, k2):
                    chain.update(b"," + ids.encode())
                else:
                    rows += [(*now, chain.hexdigest())] if now else []
                    now, chain = (depth, k1, k2), hashlib.sha256(ids.encode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), r)) for r in rows])
                rows = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), (*now, chain.hexdigest())))])

    ordered = trie.ends.withColumn("ids", F.array_join(F.col("convs").cast("array<string>"), ",")).drop("convs")
    return ordered.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "slice").mapInArrow(run, schema)
