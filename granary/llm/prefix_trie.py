"""Conversation prefix trie: digest-keyed parent edges, rolled up by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import join_spans, piece_of, position, spans
from ..sources import stage_boundary
from ._arrow import map_partition
from .jaccard_join import SALTS, fits_broadcast

#: Conversations of a family share the beginning of the one whose id this divides.
FAMILY = 5
#: So many turns of it at most: the CRC-32 of a conversation's id modulo this.
SHARED = 9
#: Characters of text by which turns of equal number and role are dealt out; the rest is compared inside a range.
DEALT = 64


def look_up(rows: DataFrame, table: DataFrame, on: Sequence[str], part: str) -> DataFrame:
    """rows with the columns of a table of one row per key, null where it has none.

    The table is broadcast if its measured bytes allow it; else a key with many rows is dealt over SALTS tasks, by the column part.
    """
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), list(on), "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], "left").drop("_salt")


def ordered_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, m1, m2, n_bytes, _place) in the order of conversation, turn, role and text, and the spans of conversations.

    m1, m2: 128 bits of a digest of role and text.  A conversation of any length lies in as many ranges as it needs.
    """
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where("conv_id IS NOT NULL")
    order = ["conv_id", F.asc_nulls_first("turn")]
    dealt = rows.repartitionByRange(*order, F.substring("role", 1, DEALT), F.substring("text", 1, DEALT)).sortWithinPartitions(*order, "role", "text")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = lambda at: F.conv(F.substring("_d", at, 16), 16, -10).cast("long")
    slim = dealt.select("conv_id", digest.alias("_d"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_place"))
    laid = stage_boundary(slim.select("conv_id", half(1).alias("m1"), half(17).alias("m2"), "n_bytes", "_place"))
    return laid, stage_boundary(spans(laid, ["conv_id"]))


def conversation_plan(table: DataFrame) -> DataFrame:
    """(conv_id, head, h, n, lead, length): turns of its own, turns taken of its head, turns once rebuilt."""
    own = table.groupBy("conv_id").agg(F.first("_rows").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED))
    plan = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), h.alias("h"))
    heads = own.select(F.col("conv_id").alias("head"), F.col("n").alias("_there"))
    lead = F.least("h", F.coalesce("_there", F.lit(0)))
    return plan.join(heads, "head", "left").select("conv_id", "head", "h", "n", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def rebuilt_turns(laid: DataFrame, table: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, n_bytes, last): each rebuilt turn with the digests of the sequences that end with it and before it.

    A sequence's digest is the sum, bit by bit without carry, of 128-bit digests of (depth, role, text); sums are made per range of a
    conversation and shifted by the earlier ranges' sums, so a long conversation's turns never meet.
    """
    known = table.join(plan.select("conv_id", "h", "lead", "length"), "conv_id")
    turns = join_spans(laid, known, ["conv_id"]).withColumn("ordinal", position())
    turns = stage_boundary(turns.withColumn("chunk", piece_of()).select("conv_id", "ordinal", "h", "lead", "length", "chunk", "m1", "m2", "n_bytes"))
    common = ["conv_id", "depth", "chunk", "length", "m1", "m2", "n_bytes"]
    own = turns.where("ordinal >= h").withColumn("depth", F.col("ordinal") - F.col("h") + F.col("lead") + 1).select(*common)
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("ordinal") < SHARED - 1)).select(F.col("conv_id").alias("head"), "ordinal", "m1", "m2", "n_bytes")
    taken = plan.join(first, "head").where("ordinal < h").withColumn("depth", F.col("ordinal") + 1).withColumn("chunk", F.lit(-1).cast("long")).select(*common)
    every = own.unionByName(taken).withColumn("z1", F.xxhash64("depth", "m1", "m2")).withColumn("z2", F.xxhash64("m2", "m1", "depth", F.lit(1)))
    every = stage_boundary(every.drop("m1", "m2"))
    sums = every.groupBy("conv_id", "chunk").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    here = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = every.select("*", F.bit_xor("z1").over(here).alias("r1"), F.bit_xor("z2").over(here).alias("r2")).join(sums, ["conv_id", "chunk"])
    x = {k: F.col(f"b{k}").bitwiseXOR(F.col(f"r{k}")) for k in (1, 2)}
    return out.select("conv_id", "depth", *(x[k].alias(f"x{k}") for k in (1, 2)), *(x[k].bitwiseXOR(F.col(f"z{k}")).alias(f"p{k}") for k in (1, 2)), "n_bytes", (F.col("depth") == F.col("length")).alias("last"))


def roll_up(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sums of the values over each node's subtree, its top included, by pointer jumping.

    nodes: conv_id and depth, their key, ``up``, the parent's conv_id, and the values.  After the round of step s a node holds the sum of its
    descendants nearer than 2 s, and points 2 s levels up: sums go to the node that is pointed at, then pointers are doubled.  So a tree of depth d
    takes log2(d) rounds, and in each only nodes below the step have a row to send.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, step = nodes.select("conv_id", "depth", "up", *values), 1
    while step <= deepest:
        below = state.where(F.col("depth") >= step)
        given = below.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        pointers = below.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("_up"))
        state = state.join(given, ["conv_id", "depth"], "left")
        state = look_up(state, pointers, ["up", "depth"], "conv_id")
        state = stage_boundary(state.select("conv_id", "depth", F.col("_up").alias("up"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)))
        step *= 2
    return state.select("conv_id", "depth", *values)


def digest_lists(rows: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of each node's members' ids, ascending and comma-joined.

    Ids are joined to texts in sorted ranges; one task then reads a node's texts in order and digests them as they come, holding one batch.
    """
    laid = rows.select("node", "depth", "conv_id").repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")

    def join(batches):
        for b in batches:
            node, depth, conv = (b.column(i).to_pylist() for i in range(3))
            at = 0
            out: list[tuple] = []
            for i in range(1, len(node) + 1):
                if i == len(node) or (node[i], depth[i]) != (node[at], depth[at]):
                    out.append((node[at], depth[at], conv[at], ",".join(map(str, conv[at:i]))))
                    at = i
            yield dict(zip(("node", "depth", "first", "ids"), zip(*out, strict=True), strict=True))

    texts = map_partition(laid, "node long, depth long, first long, ids string", join)
    texts = texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")

    def digest(batches):
        now, sha = None, None
        for b in batches:
            done = []
            for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now == (node, depth):
                    sha.update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (node, depth), hashlib.sha256(ids.encode())
            if done:
                yield dict(zip(("node", "depth", "ends_sha256"), zip(*done, strict=True), strict=True))
        if now:
            yield {"node": [now[0]], "depth": [now[1]], "ends_sha256": [sha.hexdigest()]}

    return map_partition(texts, "node long, depth long, ends_sha256 string", digest)


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("string").cast("binary"), 256)


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, a row per node, with what sharing of prefixes saves below it.

    df: conv_id, turn, role, text; turns are ordered by turn (null first), turns of equal number by role, then text, as bytes; null roles and texts are empty.
    Conversation c is rebuilt: the first h turns of c - c % 5 (all if fewer), then its own behind its first h; h is the CRC-32 of c in decimals, modulo 9.
    A node is a distinct sequence of first turns; the root is the empty one.

    1. Turns get their positions in sampled ranges, so one endless conversation is spread; texts are digested there and go no further.
    2. Digests of all prefixes are running sums; a node is one group of them and knows its parent by digest.
    3. Where one conversation alone is a member, the subtree is a path: one leaf, nothing saved.  Nodes of several members, whose ancestors have several
       too, are rolled up by pointer jumping over (smallest member, depth), which names a node.
    4. Ids of conversations that end at one node are digested in order, range by range.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Sequences are told apart by 128 bits.
    Rows of a null conv_id belong to no conversation and are left out; repeated rows are turns of their own; further columns are ignored; texts may have
    any length; a table without conversations gives no rows, not even a root.
    """
    laid, table = ordered_turns(df)
    plan = stage_boundary(conversation_plan(table))
    turns = stage_boundary(rebuilt_turns(laid, table, plan))
    grouped = turns.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("n_bytes").alias("n_bytes"),
        F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("an_end"),
    )
    nodes = stage_boundary(grouped)
    none = F.lit(0).cast("long")
    empty = plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends"), F.min(F.when(F.col("length") == 0, F.col("conv_id"))).alias("an_end")).where("n_convs > 0")
    root = empty.select(none.alias("depth"), none.alias("x1"), none.alias("x2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), none.alias("n_bytes"), "n_ends", "an_end")
    shared = stage_boundary(root.unionByName(nodes.where("n_convs > 1").select(*root.columns)))
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("up"))
    alone = look_up(nodes.where("n_convs = 1"), parents, ["depth", "p1", "p2"], "conv_id")
    alone = stage_boundary(alone.select("conv_id", "depth", "up", "n_ends"))
    shared = stage_boundary(look_up(shared, parents, ["depth", "p1", "p2"], "conv_id"))

    children = alone.where("up IS NOT NULL").select("up", "depth", F.lit(1).alias("path")).unionByName(shared.where("up IS NOT NULL").select("up", "depth", F.lit(0).alias("path")))
    children = children.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.sum("path").alias("_paths"))
    shared = shared.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", none))
    shared = shared.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("_paths", none)).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    shared = stage_boundary(shared.drop("_paths", "p1", "p2", "n_bytes"))
    sums = roll_up(shared, ["n_leaves", "saved_tokens"])

    several = shared.where("n_ends > 1 AND depth > 0").select("depth", "x1", "x2", F.col("conv_id").alias("node"))
    ends = look_up(turns.where("last").select("conv_id", "depth", "x1", "x2"), several, ["depth", "x1", "x2"], "conv_id").where("node IS NOT NULL").select("node", "depth", "conv_id")
    top = shared.where("depth = 0 AND n_ends > 1").select(F.col("conv_id").alias("node"), "depth")  # one row at most
    at_root = plan.where("length = 0").select("conv_id", none.alias("depth")).join(F.broadcast(top), "depth")
    lists = digest_lists(ends.unionByName(at_root.select("node", "depth", "conv_id"))).withColumnRenamed("node", "conv_id")

    whole = shared.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(lists, ["conv_id", "depth"], "left")
    own_end = F.when(F.col("n_ends") == 1, _sha(F.col("an_end"))).when(F.col("n_ends") == 0, _sha(F.lit("")))
    whole = whole.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", own_end).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    path = alone.select(
        "conv_id", "depth", F.coalesce("up", "conv_id").alias("parent_conv_id"), one.alias("n_convs"), (1 - F.col("n_ends")).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("n_ends") == 1, _sha(F.col("conv_id"))).otherwise(_sha(F.lit(""))).alias("ends_sha256"),
    )
    return whole.unionByName(path)
