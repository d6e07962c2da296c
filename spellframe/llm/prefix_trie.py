"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence, named by its smallest member, with the list of those that end there.
A sequence that is no proper prefix of another one is a leaf (anti-join).  The prefixes of the
weighted sequences are aggregated to nodes; what a node needs of its subtree is carried by the sequences through it, so no level
of the trie waits for another one and the depth is not bounded.

The first ``depth`` turns are known by two 64-bit sums (exclusive or) of one hash per turn, taken of its SHA-256 and its depth.
Such sums can be run along a conversation in parts: turns are ranged by (conversation, turn), so a conversation
with a third of all turns is many parts, and a part starts from the sums of the parts before it.

Cases: a null role or text is empty; rows without a conversation id are left out, the id must be an integer; a null turn comes
first; rows that share a turn (repeated ones too) stand in the order of their SHA-256; a text may have any length; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .keyed import before_part, in_ranges, join_unique

#: Conversation ids in one piece of an end list.
PIECE = 1_024
KEY = ["depth", "k1", "k2"]
HEAD = 5


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "depth", "digest")


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, part, pos (from 1), digest and n_chars of the text; written."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.monotonically_increasing_id().alias("nth"))
    order = [F.asc_nulls_first("turn"), F.col("digest"), F.col("nth")]
    ranged = stage(in_ranges(turns, "conv", order), "turns")
    starts = before_part(ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")), "conv", "part", {"start": F.sum("n")}).drop("n")
    within = Window.partitionBy("conv", "part").orderBy(*order)
    return stage(ranged.join(starts, ["conv", "part"]).select(
        "conv", "part", (F.col("start") + F.row_number().over(within)).alias("pos"), "digest", "n_chars"), "numbered")


def forked(turns: DataFrame) -> DataFrame:
    """Every conversation c as it is rebuilt: the first h turns of c - c % 100, then its own after its first h; h = crc32(c) % 6.

    One row per turn: conv, part, depth (from 1), digest, n_chars; a conversation without turns has one row of depth 0.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    convs = sizes.select("conv", "size", (F.col("conv") - F.col("conv") % 100).alias("base"), h.alias("h"))
    bases = sizes.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("size").alias("base_size"))  # at most 199 conversations each
    convs = stage(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0)))), "forks")
    heads = turns.where(F.col("conv") % 100 == 0).where(F.col("pos") <= HEAD).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "n_chars")
    first = convs.select("conv", "base", "h").join(heads, "base").where("depth <= h").select("conv", F.lit(-1).alias("part"), "depth", "digest", "n_chars")
    parts = turns.select("conv", "part").distinct().join(convs.select("conv", "h", "taken"), "conv")
    own = turns.join(parts, ["conv", "part"]).where("pos > h").select(
        "conv", "part", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "n_chars")
    bare = convs.where((F.col("taken") == 0) & (F.col("size") <= F.col("h"))).select(
        "conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return stage(first.unionByName(own).unionByName(bare), "rebuilt")


def weighted_sequences(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends: conv and key of its last turn; sequences: key, weight, rep; parts: what a part of a conversation starts from)."""
    x1, x2 = F.when(F.col("depth") > 0, _hash(1)).otherwise(0), F.when(F.col("depth") > 0, _hash(2)).otherwise(0)
    totals = rebuilt.groupBy("conv", "part").agg(F.bit_xor(x1).alias("x1"), F.bit_xor(x2).alias("x2"), F.max("depth").alias("depth"))
    parts = stage(before_part(totals, "conv", "part", {"s1": F.bit_xor("x1"), "s2": F.bit_xor("x2")}), "parts")
    ends = stage(parts.groupBy("conv").agg(F.max("depth").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2")), "ends")
    return ends, ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("rep")), parts


def prefix_nodes(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: key, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved; ends: conv and key) of rebuilt conversations."""
    ends, sequences, parts = weighted_sequences(rebuilt)
    sequences = stage(sequences, "sequences")
    reps = sequences.select(F.col("rep").alias("conv"), "weight", F.col("depth").alias("length"))
    starts = parts.select("conv", "part", "s1", "s2").join(reps, "conv")
    along = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda start, seed: F.col(start).bitwiseXOR(F.bit_xor(_hash(seed)).over(along))
    paths = rebuilt.where("depth > 0").join(starts, ["conv", "part"]).withColumns({"k1": run("s1", 1), "k2": run("s2", 2)})
    paths = stage(paths.select("conv", "part", *KEY, F.col("k1").bitwiseXOR(_hash(1)).alias("p1"), F.col("k2").bitwiseXOR(_hash(2)).alias("p2"),
                               "weight", "length", "n_chars"), "paths")

    met = stage(paths.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.max(F.col("length") > F.col("depth")).alias("goes_on")), "met")
    proper = met.where("goes_on").select(*KEY)
    leaves = sequences.join(proper, KEY, "left_anti").where("depth > 0").select(F.col("rep").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    # A node's characters are taken off once, at the smallest of the sequences through it.
    owners = met.select("conv", "depth", F.lit(1).cast("long").alias("owner"))
    kept = stage(paths.join(owners, ["conv", "depth"], "left").withColumn("kept", (F.col("weight") - F.coalesce("owner", F.lit(0))) * F.col("n_chars")).drop("owner", "n_chars"), "kept")
    totals = kept.groupBy("conv", "part").agg(F.sum("kept").alias("total"))
    below = stage(before_part(totals, "conv", "part", {"below": F.sum("total")}, after=True).join(leaves, "conv", "left"), "below")
    upward = Window.partitionBy("conv", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    carried = kept.join(below.select("conv", "part", "below", F.coalesce("leaf", F.lit(0)).alias("leaf")), ["conv", "part"])
    nodes = carried.withColumn("saved", F.col("below") + F.sum("kept").over(upward)).groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved"))
    nodes = stage(nodes, "nodes")

    zero = F.lit(0).cast("long")
    of_root = sequences.select("rep", "weight", zero.alias("n_leaves"), zero.alias("saved")).unionByName(
        nodes.where("depth = 1").select(F.lit(None).cast("long").alias("rep"), zero.alias("weight"), "n_leaves", "saved"))
    root = of_root.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
                       F.sum("saved").alias("saved")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2")], "conv_id", "n_convs", "n_leaves", "saved")
    nodes = nodes.unionByName(root)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "counted")
    above = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = join_unique(nodes, above.withColumnRenamed("n_children", "rows"), ["depth", "p1", "p2"], "rows")
    return named.drop("p1", "p2"), ends


def end_lists(ends: DataFrame) -> DataFrame:
    """Per key: SHA-256 of its conversation ids in order, comma-joined.

    Ids are joined in pieces of at most PIECE consecutive numbers, and the pieces of a key run through one hash in order: a list
    is never held, however long.
    """
    piece = ends.groupBy(*KEY, F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*KEY, "ends_sha256"]
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(k).to_pylist() for k in [*KEY, "ids"]], strict=True):
                if now != key:
                    if key is not None:
                        out.append([*key, state.hexdigest()])
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, _TYPES, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*key, state.hexdigest()], _TYPES, strict=True)], names)

    return piece.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string()]


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                rebuild=forked) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` turns numbered turns into the sequences to index; None takes them as they are.
    """
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    rebuilt = rebuild(turns) if rebuild else turns.withColumnRenamed("pos", "depth")
    nodes, ends = prefix_nodes(rebuilt)
    nodes = nodes.join(end_lists(ends), KEY, "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
