"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A text is lower-cased (A-Z only) and cut into words; each run of three
consecutive words, joined by one space, is a shingle, repeats included (fewer
words: one shingle of all of them). A bit of the 64-bit fingerprint is set where
it is set in over half the shingles' XXH64 values (seed 42).

Documents of one fingerprint are one class, named by its smallest doc_id; the
trees hold each fingerprint once. An inner node has a vantage point v and a
radius t. Two fingerprints at most r bits apart are, by the triangle bound,
either both farther than t from v, or both within t + r: so those within t + r
go to the near branch, those farther than t to the far branch, and fingerprints
of the overlap (t, t + r] to both. Every pair is whole in some leaf, whatever the
vantage points are; they and the radii only settle the sizes.

A tree fitted on a bounded sample of fingerprints (``SAMPLE``, taken in hash
order) deals all fingerprints into shards. Each shard is searched by a tree of
its own, down to leaves of LEAF fingerprints that are compared pairwise; a shard
sends on one link for each fingerprint it joined, not the pairs. Links of all
shards make the components.

Results in cases of doubt: a null text is empty; texts without words have
fingerprint zero and are linked like any other; rows without doc_id have a
fingerprint and the component that documents of this or a linked fingerprint
make (null: none), but link nothing; rows that repeat a doc_id are each a row of
the result, their texts are linked by the shared id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.kernels import SEPARATORS, U, batch, groups, text_buffer
from shopsignals.llm.minhash_forest import components
from shopsignals.llm.tables import ship, store

SIZE, BITS, SEED = 3, 3, 42
SAMPLE = 16_384  # fingerprints that the dealing tree is fitted on
LEAST_SAMPLE = 64  # of them in a leaf of the dealing tree
SHARDS_ROOT = 12  # shards: the root of the number of fingerprints over this
LEAF = 512  # fingerprints compared pairwise in a shard
VANTAGES = 12  # vantage points tried a node
SHINGLES = 1 << 16  # shingles whose bits are counted at once
PAIRS = 1 << 20  # links held before they are joined
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows, each followed by one space, as one byte array, with
    each word's start, end and row."""
    a = int(off[0])
    x = np.insert(raw[a:int(off[-1])], off[1:] - a, 0x20)  # a separator after every row
    sep = SEPARATORS[x]
    end = np.zeros(len(x), bool)
    end[1:] = sep[1:] & ~sep[:-1]
    row = np.searchsorted(off[1:] - a + np.arange(len(off) - 1), np.flatnonzero(end))
    keep = ~sep | end
    out = x[keep]
    out[sep[keep]] = 0x20
    stop = np.flatnonzero(out == 0x20)
    start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    return out, start, stop, row


def fingerprints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of every row."""
    out, start, stop, row = spaced(raw, off)
    rows = len(off) - 1
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    shingles = np.where(n > 0, np.maximum(n - SIZE + 1, 1), 0)
    of = np.repeat(np.arange(rows), shingles)
    lead = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[of]
    last = np.minimum(lead + SIZE, first[of] + n[of]) - 1
    text = LOWER[out].tobytes()
    counts = np.zeros((rows, 64), np.int64)
    for i in range(0, len(of), SHINGLES):
        part = slice(i, i + SHINGLES)
        h = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(start[lead[part]].tolist(), stop[last[part]].tolist())], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.concatenate(([True], of[part][1:] != of[part][:-1])))
        counts[of[part][head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    ones = 2 * counts > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def _signed():
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def apply(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            doc = b.column("doc_id")
            for i, j in groups(off):
                yield batch(schema, doc.slice(i, j - i), fingerprints(raw, off[i:j + 1]).astype(U))
    return apply


def vantage(x: np.ndarray, bits: int, tries: np.ndarray) -> tuple[np.uint64, int, float]:
    """Of the vantage points tried, the one and its radius whose larger branch is
    smallest, and that branch's share of ``x``."""
    best = (x[0], 64, 1.0)
    for v in x[tries]:
        upto = np.cumsum(np.bincount(np.bitwise_count(x ^ v), minlength=65 + bits))
        larger = np.maximum(upto[bits:bits + 65], len(x) - upto[:65])
        t = int(np.argmin(larger))
        if larger[t] < best[2] * len(x):
            best = (v, t, larger[t] / len(x))
    return best


def fit_tree(sample: np.ndarray, shards: int, bits: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, near, far) of a tree of about ``shards``
    leaves, the first node being the root; a child below zero is the shard
    -1 - child. The largest leaf is split first."""
    rnd = np.random.default_rng(11)
    nodes: list[tuple[int, int, int, int]] = []
    leaves, done = [(sample, None, 0)], []  # rows, parent, branch
    while leaves and len(leaves) + len(done) < shards:
        leaves.sort(key=lambda x: len(x[0]))
        x, parent, branch = leaves.pop()
        if len(x) < 2 * LEAST_SAMPLE:
            done.append((x, parent, branch))
            continue
        v, t, share = vantage(x, bits, rnd.integers(0, len(x), VANTAGES))
        if share > 0.9:  # one ball: no radius parts it
            done.append((x, parent, branch))
            continue
        d = np.bitwise_count(x ^ v)
        here = len(nodes)
        nodes.append((int(v), t, 0, 0))
        if parent is not None:
            nodes[parent] = nodes[parent][:2 + branch] + (here,) + nodes[parent][3 + branch:]
        leaves += [(x[d <= t + bits], here, 0), (x[d > t], here, 1)]
    for k, (_, parent, branch) in enumerate(done + leaves):
        if parent is not None:
            nodes[parent] = nodes[parent][:2 + branch] + (-1 - k,) + nodes[parent][3 + branch:]
    return nodes


def deal(x: np.ndarray, nodes: list[tuple[int, int, int, int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``x``, shard) of every shard that a fingerprint goes to."""
    if not nodes:
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    at, shard, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        k, i = todo.pop()
        if k < 0 or not len(i):
            at.append(i)
            shard.append(np.full(len(i), -1 - k, np.int64))
            continue
        v, t, near, far = nodes[k]
        d = np.bitwise_count(x[i] ^ np.uint64(v))
        todo += [(near, i[d <= t + bits]), (far, i[d > t])]
    return np.concatenate(at), np.concatenate(shard)


def _dealt(nodes, bits: int):
    schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])

    def apply(batches):
        for b in batches:
            fp, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            at, shard = deal(fp.view(U), nodes, bits)
            yield batch(schema, shard, fp[at], node[at])
    return apply


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each row's smallest known fellow) after the links (a, b)."""
    while True:
        ra, rb = root[a], root[b]
        new = ra != rb
        if not new.any():
            return root
        a, b, ra, rb = a[new], b[new], ra[new], rb[new]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def linked(x: np.ndarray, bits: int) -> np.ndarray:
    """For each of the distinct fingerprints ``x`` the smallest index that links
    of at most ``bits`` differing bits reach, found by a vantage-point tree."""
    rnd = np.random.default_rng(5)
    root = np.arange(len(x))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    todo = [np.arange(len(x))]
    while todo:
        i = todo.pop()
        if len(i) < 2:
            continue
        if len(i) > LEAF:
            v, t, share = vantage(x[i], bits, rnd.integers(0, len(i), 3))
            if share < 0.9:
                d = np.bitwise_count(x[i] ^ v)
                todo += [i[d <= t + bits], i[d > t]]
                continue
        for r in range(0, len(i), LEAF):  # a leaf, or one ball that no radius parts
            rows = x[i[r:r + LEAF]]
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ x[i[r:]][None, :]) <= bits)
            new = a < b
            held.append((i[r + a[new]], i[r + b[new]]))
            size += int(new.sum())
            if size > PAIRS:
                root, held, size = joined(root, *(np.concatenate(c) for c in zip(*held))), [], 0
    if held:
        root = joined(root, *(np.concatenate(c) for c in zip(*held)))
    return root


def _searched(bits: int):
    """Scan of rows sorted by (shard, node): links (a, b) from every fingerprint
    to the smallest node that its shard joins it to. One shard is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def done(held):
        fp, node = (np.concatenate(c) for c in zip(*held))
        root = linked(fp.view(U), bits)
        i = np.flatnonzero(root != np.arange(len(root)))
        return batch(schema, node[root[i]], node[i])

    def apply(batches):
        held, last = [], None
        for b in batches:
            shard, fp, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "node"))
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if held and last != shard[i]:
                    yield done(held)
                    held = []
                last = shard[i]
                held.append((fp[i:j].copy(), node[i:j].copy()))
        if held:
            yield done(held)
    return apply


def components_by_fingerprint(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits) and
    component_id, the smallest doc_id that links of at most ``bits`` differing
    bits reach."""
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = store(texts.mapInArrow(_signed(), "doc_id long, fp long"), "fingerprints")
    named = signed.where("doc_id is not null")
    classes = store(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    # one id under two fingerprints links their classes
    ids = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    again = named.join(ids, "doc_id").select("doc_id", "fp").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    n = classes.count()
    shards = max(1, round(n ** 0.5 / SHARDS_ROOT))
    sample = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64)
    nodes = fit_tree(sample.view(U), shards, bits) if n else []
    dealt = classes.mapInArrow(_dealt(nodes, bits), "shard long, fp long, node long")
    links = (dealt.repartition(shards, "shard").sortWithinPartitions("shard", "node")
             .mapInArrow(_searched(bits), "a long, b long"))
    roots = components(links.unionByName(again)).withColumnRenamed("node", "_r")
    named = store(classes.join(roots, classes["node"] == roots["_r"], "left")
                  .select(F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("component_id")), "components")
    # two stored tables: the side of a fingerprint that many documents share can be split
    return (signed.join(named, signed["fp"] == named["_fp"], "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
