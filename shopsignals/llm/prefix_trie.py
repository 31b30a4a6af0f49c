"""Prefix trie of conversations by whole-sequence collapse.

Every conversation is one sequence of (role, text) turns, named by a 128-bit
fingerprint that is an XOR over its turns (salted by their depth), so that the
fingerprint of every prefix is a running one. Equal sequences collapse into one
weighted sequence with its members' ids as end list. The prefixes of the distinct
sequences, weighted, are aggregated into nodes; a sequence that is a proper
prefix of another (anti-join) is no leaf. No task holds a conversation or a node's
members: running values are range split (``running``), lists are cut by id.

Sums over subtrees need no walk. With w the weight of a sequence S and b(S, d)
the text bytes of its turns from depth d on, the sum of n_convs * bytes below a
node of depth d is the sum of w * b(S, d) over its sequences. The sum of each
node's bytes, once, is had by owners: a node belongs to the sequence of its
smallest member, a sequence owns the nodes from some depth o on, and adds
b(S, max(d, o)) to each of its prefixes.

Results in cases of doubt: rows without conv_id are left out; a null role or text
is empty; turns of one number are taken in the order of role and text by their
fingerprints, null numbers first; ids take the remainder of SQL (its sign is the
dividend's); no conversations have no trie, not even a root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.llm.tables import ship, store

CHUNK = 512  # ids of one piece of an end list: it spans so many consecutive ids


def running(df: DataFrame, key: str, order: list[str], **sums) -> DataFrame:
    """``df`` with running aggregates (columns over a window, up to and with the
    row) of the rows of each key in ``order``. Rows are range split, so a key of
    many rows is dealt over several tasks; what a piece begins with comes from a
    table of the first and last key of every partition."""
    split = store(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    piece = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = split.groupBy("_part").agg(F.array(F.min(key), F.max(key)).alias("k")).select("_part", F.explode("k").alias(key)).distinct()
    whole = split.join(F.broadcast(ends), ["_part", key], "left_semi").groupBy("_part", key).agg(*[f(c).alias(n) for n, (f, c) in sums.items()])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    given = whole.select("_part", key, *[f(n).over(before).alias(f"_{n}") for n, (f, _) in sums.items()])
    out = split.select("*", *[f(c).over(piece).alias(n) for n, (f, c) in sums.items()]).join(F.broadcast(given), ["_part", key], "left")
    total = {n: (F.col(n).bitwiseXOR if f is F.bit_xor else F.col(n).__add__)(F.coalesce(F.col(f"_{n}"), F.lit(0))) for n, (f, _) in sums.items()}
    return out.withColumns(total).drop("_part", *[f"_{n}" for n in sums])


def spliced(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, turns): every conversation (c, depth: its rebuilt turns), and its
    rebuilt turns (c, d from 1, t1, t2 of role and text, bytes of the text). With h
    the CRC-32 of the decimal c modulo 9, c gets the first h turns of conversation
    c - c % 5 in place of its own first h."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    raw = (conversations.where("conv_id is not null")
           .select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
                   F.xxhash64(text, F.lit(1), role).alias("t2"), F.octet_length(text).cast("long").alias("bytes")))
    turns = store(running(raw, "c", ["turn", "t1", "t2", "bytes"], at=(F.sum, F.lit(1).cast("long"))), "turns")
    size = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    base = size.select(F.col("c").alias("base"), F.col("n").alias("m"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    heads = size.withColumns({"h": h, "base": F.col("c") - F.col("c") % 5}).join(base, "base", "left")
    heads = store(heads.select("c", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("given"), "n")
                  .withColumn("depth", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "heads")
    own = (turns.join(heads.select("c", "h", "given"), "c").where("at > h")
           .select("c", (F.col("at") - F.col("h") + F.col("given")).alias("d"), "t1", "t2", "bytes"))
    first = turns.where("at <= 8 and c % 5 = 0").select(F.col("c").alias("base"), F.col("at").alias("d"), "t1", "t2", "bytes")
    taken = first.join(heads.select("c", "base", "given"), "base").where("d <= given").select("c", "d", "t1", "t2", "bytes")
    return heads.select("c", "depth"), own.unionByName(taken)


def _hashed():
    schema = pa.schema([("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])

    def apply(batches):
        """Scan of pieces sorted by (d, f1, f2, chunk): the digest of each list."""
        last, sha = None, None
        for b in batches:
            res = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in ("d", "f1", "f2", "ids"))):
                if key != last:
                    if last is not None:
                        res.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in res], f.type) for k, f in enumerate(schema)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*last, sha.hexdigest()), schema)], schema=schema)
    return apply


NODE = ["d", "f1", "f2"]


def _end_lists(whole: DataFrame) -> DataFrame:
    """The digest of the ids of each sequence's members, ascending, joined by
    commas: ids are joined in pieces of a bounded range first, so that the task
    that reads a long list in order reads few rows and holds one."""
    pieces = (whole.groupBy(*NODE, F.floor(F.col("c") / CHUNK).alias("chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")))
    return (pieces.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
            .mapInArrow(_hashed(), "d long, f1 long, f2 long, ends_sha256 string"))


def prefix_nodes(heads: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of the sequences ``turns`` (c, d from 1 without gaps, t1, t2,
    bytes) of the conversations ``heads`` (c, depth): one row a distinct prefix.
    conv_id smallest member; depth; parent_conv_id; n_convs members; n_children;
    n_leaves childless nodes in its subtree; saved_tokens, (members - 1) times the
    bytes of the last text summed over the subtree; ends_sha256 of its end list."""
    ship(heads.sparkSession)
    salted = turns.withColumns({"t1": F.xxhash64("d", "t1"), "t2": F.xxhash64("d", "t2")})
    rows = store(running(salted, "c", ["d"], f1=(F.bit_xor, F.col("t1")), f2=(F.bit_xor, F.col("t2")), upto=(F.sum, F.col("bytes"))), "prefixes")
    ends = rows.select(F.col("c").alias("_c"), F.col("d").alias("_d"), "f1", "f2", "upto")
    zero = F.lit(0).cast("long")
    whole = store(heads.join(ends, (F.col("c") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
                  .select("c", F.col("depth").alias("d"), *[F.coalesce(x, zero).alias(x) for x in ("f1", "f2", "upto")]), "sequences")
    # collapse: one weighted sequence for all equal ones, under its smallest id
    sequences = store(whole.groupBy(*NODE).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("weight"), F.first("upto").alias("total")), "collapsed")
    below = rows.join(sequences.select("c", "weight"), "c").select(
        "c", "d", "f1", "f2", F.col("f1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("f2").bitwiseXOR(F.col("t2")).alias("p2"),
        (F.col("upto") - F.col("bytes")).alias("above"), "weight")
    root = sequences.select("c", *[zero.alias(x) for x in ("d", "f1", "f2", "p1", "p2", "above")], "weight")
    prefixes = store(below.unionByName(root), "weighted")
    # a sequence that is a proper prefix of another is an inner node
    inner = prefixes.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("c", F.lit(1).alias("leaf"))
    owners = prefixes.groupBy(*NODE).agg(F.min("c").alias("c"), F.first("above").alias("above"))
    owned = owners.groupBy("c").agg(F.min("d").alias("o"), F.min("above").alias("owned_above"))
    known = store(sequences.select("c", "total").join(leaves, "c", "left").join(owned, "c", "left"), "known")
    parts = prefixes.join(known, "c").select(
        *NODE, "p1", "p2", "c", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"),
        (F.col("weight") * (F.col("total") - F.col("above"))
         - F.coalesce(F.col("total") - F.greatest("above", "owned_above") * F.when(F.col("o").isNotNull(), 1), zero)).alias("saved"))
    nodes = store(parts.groupBy(*NODE).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("c").alias("conv_id"), F.sum("weight").alias("n_convs"),
                                           F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "nodes")
    children = (nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    # one row a node on both sides
    node = store(nodes.join(children, NODE, "left").join(_end_lists(whole), NODE, "left"), "nodes")
    up = node.where("n_children is not null").select((F.col("d") + 1).alias("_d"), F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.col("conv_id").alias("parent_conv_id"))
    # two stored tables: the children of one node can be split
    return (node.join(up, (node["d"] == up["_d"]) & (node["p1"] == up["_1"]) & (node["p2"] == up["_2"]), "left")
            .select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt by ``spliced``."""
    return prefix_nodes(*spliced(conversations))
