"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its runs of ``WORDS`` consecutive words (fewer words:
one run of all of them). Documents of one set are one text class, named by its
smallest doc_id, and take part as one node.

The forest holds each node's minhash values as labels of sorted prefix tries. Two
nodes of similarity s share the first d values of a trie with probability s**d.
How much of the labels must match depends on how crowded a prefix is:

* every node enters ``TREES`` tries; the prefix that must match is shortened from
  ``DEPTH`` until the chance that some trie brings two nodes at the threshold
  together, 1 - (1 - s**d)**TREES, reaches the target recall;
* a prefix of at most LISTED nodes lists its pairs. The nodes of more crowded
  prefixes (a template that many texts share) enter a second forest of longer
  prefixes, up to ``DEPTH`` values, with as many more tries as keep the recall
  (``deeper``). Two nodes that only meet under crowded prefixes are both in it, so
  they are missed no more often; texts that have less in common than the
  threshold part there;
* what is crowded even in the second forest is mostly similar indeed: such a
  prefix is split by hash into parts of about CROWD nodes, and each two parts are
  compared as one block, which sends on the number of links of each node and links
  enough to join what it found similar, not the pairs. A crowd of m nodes costs
  m * m comparisons, and m * m / CROWD copies of its texts, a trie.

Listed pairs, once for both forests, are verified on the whole sets.

Links make groups (connected components), found by repeated contraction to
smaller ids.

Results in cases of doubt: words are taken unchanged; a text without words, or a
null one, is alone in its group, as is a row without doc_id, whose group is
null; rows that repeat a doc_id are one document (of different texts under one
id, that of the smallest set fingerprint stands for it, the others link nothing);
other columns are ignored or, in ``keep_one``, kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.kernels import M1, M2, M3, U, batch, grams, groups, mix, text_buffer, word_ids, words
from shopsignals.llm.tables import ship, store

WORDS, TREES, DEPTH = 5, 16, 6
DEEP = 64  # most tries of the second forest
LISTED = 16  # most nodes of a prefix whose pairs are listed; more are compared in blocks
CROWD = 512  # nodes of a part of a crowded prefix; a block holds two parts
COLUMNS = 4096  # shingles compared at once in a block
BROADCAST_IDS = 500_000  # most ids of texts to verify that are broadcast (two longs each)


def prefix_depth(threshold: float, recall: float) -> int:
    """The longest prefix that reaches the recall at the threshold."""
    for d in range(DEPTH, 0, -1):
        if 1 - (1 - threshold ** d) ** TREES >= recall:
            return d
    return 1


def deeper(threshold: float, depth: int) -> tuple[int, int] | None:
    """(depth, tries) of the second forest: the longest prefix up to ``DEPTH`` at
    which at most DEEP tries miss a pair at the threshold no more often than TREES
    tries do at ``depth``; None if there is none longer than ``depth``."""
    for d in range(DEPTH, depth, -1):
        tries = math.ceil(TREES * math.log1p(-threshold ** depth) / math.log1p(-threshold ** d)) if threshold < 1 else TREES
        if tries <= DEEP:
            return d, tries
    return None


def family(seed: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the hash functions of a forest, by trie and depth."""
    rnd = np.random.default_rng(seed)
    factor = rnd.integers(1, 1 << 63, tries * DEPTH, dtype=np.uint64) * U(2) + U(1)
    return factor.reshape(tries, DEPTH), rnd.integers(0, 1 << 63, tries * DEPTH, dtype=np.uint64).reshape(tries, DEPTH)


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle identifiers of the rows, sorted within a row, end to end,
    and the row of each."""
    ws, we, row = words(raw, off)
    ids = word_ids(raw, ws, we)
    g = grams(ids, size)
    r = row[:len(g)]
    inside = r == row[size - 1:] if len(g) else np.zeros(0, bool)
    n = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((n > 0) & (n < size))
    begin = np.cumsum(n) - n
    few = np.array([np.bitwise_xor.reduce((ids[begin[i]:begin[i] + n[i]] + np.arange(1, n[i] + 1).astype(U) * M2) * M1) for i in short], U)
    g, r = np.concatenate((g[inside], few)), np.concatenate((r[inside], short))
    o = np.lexsort((g, r))
    g, r = g[o], r[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new]


def _sign(depth: int, tries: int, seed: int):
    """Fingerprint and size of each text's set, and its prefix in each trie."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()),
                        ("labels", pa.list_(pa.int64()))])

    def apply(batches):
        factor, offset = family(seed, tries)
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            doc, x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "x"))
            for i, j in groups(off):
                g, r = shingle_sets(raw, off[i:j + 1])
                if not len(g):
                    continue
                head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                key = np.arange(1, tries + 1, dtype=np.uint64) * M3 + np.full((len(head), 1), seed, U)
                for t in range(tries):
                    for k in range(depth):
                        h = g * factor[t, k]
                        h += offset[t, k]
                        h >>= U(32)
                        key[:, t] = mix(key[:, t], np.minimum.reduceat(h, head) + U(k + 1))
                own = mix(g, g ^ M3)
                f1, f2 = np.add.reduceat(own, head), np.bitwise_xor.reduceat(own * M2, head)
                labels = pa.ListArray.from_arrays(np.arange(0, key.size + 1, tries, dtype=np.int32), pa.array(key.ravel().view(np.int64)))
                at = i + r[head]
                yield batch(schema, doc[at], x[at], f1, f2, np.diff(np.append(head, len(g))), labels)
    return apply


def _all_pairs(threshold: float):
    """Scan of rows sorted by (key, node), of at most LISTED a key: all pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def apply(batches):
        held = None  # the last LISTED rows
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "n")]
            old = 0
            if held is not None:
                old = len(held[0])
                cols = [np.concatenate((x, c)) for x, c in zip(held, cols)]
            key, node, n = cols
            for k in range(1, LISTED):
                i = np.arange(max(old, k), len(key))
                i = i[key[i] == key[i - k]]
                j = i - k
                close = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])  # else no set is that similar
                yield batch(schema, node[j[close]], node[i[close]])
            held = [c[-LISTED:] for c in cols]
    return apply


def _common(values: np.ndarray, row: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of values that each of the rows ``left`` has in common with each of
    ``right``; the values of a row are distinct."""
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    _, at = np.unique(at[shared], return_inverse=True)
    row = row[shared]
    o = np.argsort(at, kind="stable")
    at, row = at[o], row[o]
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2 ** 24
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, (c, c + COLUMNS))
        held = np.zeros((rows, COLUMNS), np.float32)
        held[row[i:j], at[i:j] - c] = 1
        out += held[left] @ held[right].T
    return out


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (parent, child) that join what ``linked`` (symmetric) joins, from the
    first row of each component outwards."""
    left = np.ones(len(linked), bool)
    up, down = [], []
    for r in range(len(linked)):
        if not left[r]:
            continue
        left[r] = False
        todo = [r]
        while todo:
            x = todo.pop(0)
            y = np.flatnonzero(linked[x] & left)
            left[y] = False
            up.append(np.full(len(y), x))
            down.append(y)
            todo += y.tolist()
    return np.concatenate(up), np.concatenate(down)


def _block(key, half, node, crowds, text, threshold: float):
    """All pairs of one block: links enough to join what is similar, with their
    similarity, and each node's number of links. A pair counts, for both, only
    under the smallest crowded prefix that its nodes share."""
    raw, off = text_buffer(text)
    parts = [(g, r + i) for i, j in groups(off) for g, r in [shingle_sets(raw, off[i:j + 1])]]
    g, r = (np.concatenate(x) for x in zip(*parts))
    m, n = len(node), np.bincount(r, minlength=len(node))
    one = half[0] == half[-1]
    left, right = (np.arange(m), np.arange(m)) if one else (np.flatnonzero(half == half[0]), np.flatnonzero(half != half[0]))
    both = _common(g, r, m, left, right).astype(np.float64)
    s = both / np.maximum(n[left][:, None] + n[right][None, :] - both, 1)
    ok = s >= threshold
    if one:
        np.fill_diagonal(ok, False)
    size = np.diff(crowds.offsets.to_numpy())
    k, row = crowds.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(m), size)
    counted = ok & (_common(k[k < key], row[k < key], m, left, right) == 0)
    degree = np.zeros(m, np.int64)
    degree[left] += counted.sum(1)
    if not one:
        degree[right] += counted.sum(0)
    full, value = np.zeros((m, m), bool), np.zeros((m, m))
    full[np.ix_(left, right)], value[np.ix_(left, right)] = ok, s
    o = np.argsort(node)
    up, down = (o[x] for x in _spanning((full | full.T)[np.ix_(o, o)]))
    first = np.zeros((m, m), bool)
    first[np.ix_(left, right)] = counted
    new = first[up, down] | first[down, up]  # the ends of the others are joined under the smaller prefix that they share
    up, down = up[new], down[new]
    return node[up], node[down], np.maximum(value[up, down], value[down, up]), degree


def _blocks(threshold: float):
    """Scan of rows sorted by (key, lo, hi, part, node): a row a link (a, b,
    similarity), and a row a node (a, links). One block is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("links", pa.int64())])

    def done(held):
        t = pa.Table.from_batches(held).combine_chunks()
        part, node = (t.column(c).to_numpy() for c in ("part", "node"))
        a, b, s, degree = _block(t.column("key")[0].as_py(), part, node, t.column("crowds").combine_chunks(),
                                 t.column("text").combine_chunks(), threshold)
        yield batch(schema, np.minimum(a, b), np.maximum(a, b), s, np.zeros(len(a), np.int64))
        yield batch(schema, node, node, np.ones(len(node)), degree)

    def apply(batches):
        held, last = [], None
        for b in batches:
            block = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")])
            edges = [0, *(np.flatnonzero((block[:, 1:] != block[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges[:-1], edges[1:]):
                if j == i:
                    continue
                if held and last != tuple(block[:, i]):
                    yield from done(held)
                    held = []
                last = tuple(block[:, i])
                held.append(b.slice(i, j - i))
        if held:
            yield from done(held)
    return apply


def _similar(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def apply(batches):
        for b in batches:
            sides = [text_buffer(b.column(c)) for c in ("ta", "tb")]
            total = sides[0][1] + sides[1][1]
            s = np.zeros(b.num_rows)
            for i, j in groups(total):
                (ga, ra), (gb, rb) = (shingle_sets(raw, off[i:j + 1]) for raw, off in sides)
                ha, hb = mix(ga, ra.astype(U) * M3), mix(gb, rb.astype(U) * M3)
                both = np.bincount(ra[np.isin(ha, hb)], minlength=j - i)
                every = np.bincount(ra, minlength=j - i) + np.bincount(rb, minlength=j - i) - both
                s[i:j] = both / np.maximum(every, 1)
            ok = s >= threshold
            a, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b"))
            yield batch(schema, a[ok], c[ok], s[ok])
    return apply


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of every node in ``links``
    (a, b). Nodes point to their smallest neighbour, pointers are followed twice,
    and links between the roots go on, until none is left."""
    edges = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = edges.sparkSession.createDataFrame([], "node long, root long")
    begun = False
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
        for _ in range(2):
            up = store(up, "pointers")
            on = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            up = up.join(on, up["root"] == on["_n"]).select("node", F.col("_r").alias("root"))
        up = store(up, "pointers")
        ends = [up.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}")) for c in "ab"]
        edges = store(edges.join(ends[0], edges["a"] == ends[0]["_a"]).join(ends[1], edges["b"] == ends[1]["_b"])
                      .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if begun:
            on = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            up = roots.join(on, roots["root"] == on["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
        roots, begun = store(up, "roots"), True
    return roots


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    side = lambda c: texts.select(F.col("node").alias(f"_{c}"), F.col("text").alias(f"t{c}"))
    full = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return store(full.select("a", "b", "ta", "tb").mapInArrow(_similar(threshold), "a long, b long, similarity double"), "links")


SIGNED_DDL = "doc_id long, x long, f1 long, f2 long, n long, labels array<long>"


def _prefixes(nodes: DataFrame, name: str) -> DataFrame:
    """key, many, node, n: the prefixes of all tries that two nodes or more share."""
    rows = nodes.select("node", "n", F.explode("labels").alias("key"))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").withColumnRenamed("key", "_key")
    return store(rows.join(many, rows["key"] == many["_key"]).select("key", "many", "node", "n"), name)


def _bodies(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (node, x, text) that stand for the ``wanted`` nodes."""
    wanted = store(nodes.select(F.col("node").alias("_node"), F.col("x").alias("_x")).join(wanted, F.col("_node") == wanted["node"], "left_semi"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)  # beyond that the texts are exchanged by node
    return (texts.join(wanted, (texts["doc_id"] == wanted["_node"]) & (texts["x"] == wanted["_x"]), "left_semi")
            .withColumnRenamed("doc_id", "node").dropDuplicates(["node"]))


def _joined(documents: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, links, roots): the node of every document (doc_id, node), the
    verified links between nodes (a, b, similarity) that make the groups, the groups
    of linked nodes (node, root), and all links of each node (node, n_links)."""
    ship(documents.sparkSession)
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
    depth = prefix_depth(threshold, recall)
    signed = store(texts.mapInArrow(_sign(depth, TREES, 7), SIGNED_DDL), "signatures")
    one = store(signed.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "x")).alias("s")).select("doc_id", "s.*"), "standing")
    # stored, so that the joins below read two exchanges and a large class can be split
    classes = store(one.groupBy("f1", "f2").agg(F.min("doc_id").alias("node")), "classes")
    members = store(one.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).select("doc_id", "node"), "members")
    named = classes.select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "node")
    nodes = store(signed.join(named, (signed["doc_id"] == named["node"]) & (signed["f1"] == named["_f1"]) & (signed["f2"] == named["_f2"]))
                  .groupBy("node").agg(F.min("x").alias("x"), F.first("n").alias("n"), F.first("labels").alias("labels")), "nodes")
    rows = _prefixes(nodes, "prefixes")
    few = rows.where(F.col("many") <= LISTED)
    crowded = rows.where(F.col("many") > LISTED)
    second = deeper(threshold, depth)
    if second:
        again = _bodies(texts, nodes, crowded.select("node").distinct())
        again = again.select(F.col("node").alias("doc_id"), "x", "text").mapInArrow(_sign(*second, 8), SIGNED_DDL)
        rows = _prefixes(store(again.select(F.col("doc_id").alias("node"), "n", "labels"), "deep-signatures"), "deep-prefixes")
        few = few.unionByName(rows.where(F.col("many") <= LISTED))
        crowded = rows.where(F.col("many") > LISTED)
    crowds = store(crowded.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("crowds")), "crowds")
    pairs = (few.select("key", "node", "n").repartition("key").sortWithinPartitions("key", "node")
             .mapInArrow(_all_pairs(threshold), "a long, b long").distinct())
    ca, cb = (crowds.select(F.col("node").alias(f"_{c}"), F.col("crowds").alias(f"c{c}")) for c in "ab")
    # pairs that share a crowded prefix are counted in its blocks
    pairs = store(pairs.join(ca, F.col("a") == F.col("_a"), "left").join(cb, F.col("b") == F.col("_b"), "left")
                  .where("not coalesce(arrays_overlap(ca, cb), false)").select("a", "b"), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowds.select("node")).distinct()
    bodies = store(_bodies(texts, nodes, wanted), "texts")
    listed = _verified(pairs, bodies, threshold)
    parts = F.ceil(F.col("many") / CROWD)
    blocks = (crowded.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
              .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node")
              .join(crowds, "node").join(bodies.select("node", "text"), "node"))
    found = store(blocks.select("key", "lo", "hi", "part", "node", "crowds", "text").repartition("key", "lo", "hi")
                  .sortWithinPartitions("key", "lo", "hi", "part", "node")
                  .mapInArrow(_blocks(threshold), "a long, b long, similarity double, links long"), "blocks")
    links = store(listed.unionByName(found.where("a <> b").select("a", "b", "similarity").dropDuplicates(["a", "b"])), "links")
    degree = (listed.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links"))
              .unionByName(found.where("a = b").select(F.col("a").alias("node"), "links"))
              .groupBy("node").agg(F.sum("links").alias("n_links")))
    return members, links, components(links), degree


def near_duplicates(documents: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, roots) of ``_joined``."""
    return _joined(documents, threshold, recall)[:3]


def classes(documents: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of its group),
    text_id (smallest doc_id of its text class) and n_links (verified links of its
    text to other texts)."""
    members, _, roots, degree = _joined(documents, threshold, recall)
    degree = degree.withColumnRenamed("node", "_d")
    r = roots.withColumnRenamed("node", "_r")
    nodes = members.select("node").distinct()
    nodes = nodes.join(r, nodes["node"] == r["_r"], "left").join(degree, nodes["node"] == degree["_d"], "left")
    # one stored row a text, so that the copies of one text can be split; texts without words stay out of this join
    nodes = store(nodes.select(F.col("node").alias("_n"), "root", "n_links"), "node-groups")
    known = members.join(nodes, members["node"] == nodes["_n"]).select(F.col("doc_id").alias("_m"), "node", "root", "n_links")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = docs.join(known, docs["doc_id"] == known["_m"], "left")
    return out.select("doc_id", F.coalesce("root", "node", "doc_id").alias("class_id"), F.coalesce("node", "doc_id").alias("text_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(documents: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The documents without those that have a smaller doc_id in their group."""
    members, _, roots = near_duplicates(documents, threshold, recall)
    r = roots.withColumnRenamed("node", "_r")
    m = members.join(r, members["node"] == r["_r"], "left")
    gone = m.where("doc_id <> coalesce(root, node)").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
