"""Exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against every query; no pass keeps the scores. The
first pass finds each query's least and greatest score, each further pass
counts the scores of the range still in question in equal bins and keeps the
bin that holds the k-th greatest, until bins are one integer wide: that is the
k-th value. A last pass keeps the scores above it, and of those equal to it the
k smallest vec_ids of each task, so ties never travel in full.

Queries go in blocks of ``query_block`` vectors, the only thing broadcast. The
tasks return histograms added up per task, so what is shuffled grows with tasks
and queries, not with scored pairs.

Results in cases of doubt: a component x counts as floor(1024 * x) of the double
x; vectors that are null, or hold null or non-finite components, and rows
without vec_id take no part; only vectors of one length are scored with one
another; ties go to the smaller vec_id; rows that repeat a vec_id are candidates
of their own, but for the query's own id. Scores beyond 64 bits wrap as SQL long
arithmetic does outside ANSI mode. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.llm.tables import ship, store

BINS = 1024
EXACT = float(1 << 53)


def _groups(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scaled integer vectors) of the valid vectors, by vector length."""
    ids, col = b.column(0), b.column(1)
    flat = pc.fill_null(col.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    size = np.where(np.asarray(col.is_valid()) & np.asarray(ids.is_valid()), pc.fill_null(pc.list_value_length(col), 0), -1)
    end = np.cumsum(np.maximum(np.where(np.asarray(col.is_valid()), pc.fill_null(pc.list_value_length(col), 0), 0), 0))
    ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == dim)
        v = flat[(end[rows] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(v).all(axis=1)
        yield ids[rows[good]], np.floor(v[good] * 1024)


class Scorer:
    """Integer scores of vectors against one block of queries.

    Products of floats are exact integers while every sum stays below 2**53;
    other vectors are multiplied as 64-bit integers."""

    def __init__(self, ids: np.ndarray, dims: np.ndarray, vectors: np.ndarray, offsets: np.ndarray):
        self.sets = {}
        for dim in np.unique(dims):
            q = np.flatnonzero(dims == dim)
            m = vectors[offsets[q][:, None] + np.arange(dim)]
            self.sets[int(dim)] = (q, ids[q], m, float(np.abs(m).max(initial=0)))

    def scores(self, b: pa.RecordBatch, step: int = 2048):
        """(query positions, query ids, vec ids, scores[vec, query])."""
        for ids, v in _groups(b):
            dim = v.shape[1]
            if dim not in self.sets:
                continue
            q, qid, m, top = self.sets[dim]
            for i in range(0, len(v), step):
                x = v[i:i + step]
                if float(np.abs(x).max(initial=0)) * top * max(dim, 1) < EXACT:
                    s = (x @ m.T).astype(np.int64)
                else:
                    with np.errstate(invalid="ignore", over="ignore"):
                        s = x.astype(np.int64) @ m.astype(np.int64).T
                yield q, qid, ids[i:i + step], s


def _ranges(scorer: Scorer, total: int):
    def apply(batches):
        lo = np.full(total, np.iinfo(np.int64).max)
        hi = np.full(total, np.iinfo(np.int64).min)
        n = np.zeros(total, np.int64)
        for b in batches:
            for q, qid, ids, s in scorer.scores(b):
                own = ids[:, None] == qid
                lo[q] = np.minimum(lo[q], np.where(own, np.iinfo(np.int64).max, s).min(axis=0))
                hi[q] = np.maximum(hi[q], np.where(own, np.iinfo(np.int64).min, s).max(axis=0))
                n[q] += (~own).sum(axis=0)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (np.arange(total), lo, hi, n)], ["q", "lo", "hi", "n"])
    return apply


def _histogram(scorer: Scorer, lo: np.ndarray, hi: np.ndarray, width: np.ndarray):
    """Counts per query and bin of the scores in [lo, hi]."""
    def apply(batches):
        count = np.zeros((len(lo), BINS), np.int64)
        for b in batches:
            for q, qid, ids, s in scorer.scores(b):
                ok = (s >= lo[q]) & (s <= hi[q]) & (ids[:, None] != qid)
                r, c = np.nonzero(ok)
                at = (s[r, c] - lo[q][c]) // width[q][c]
                np.add.at(count, (q[c], at), 1)
        q, at = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at), pa.array(count[q, at])], ["q", "bin", "n"])
    return apply


def _above(scorer: Scorer, kth: np.ndarray, k: int):
    """Scores above the k-th value, and the k smallest ids of those equal to it."""
    def apply(batches):
        best: list[np.ndarray] = []

        def prune():
            t = np.concatenate(best, axis=1) if best else np.zeros((3, 0), np.int64)
            t = t[:, np.lexsort((t[1], -t[2], t[0]))]
            first = np.searchsorted(t[0], t[0])
            return t[:, np.arange(t.shape[1]) - first < k]
        held = 0
        for b in batches:
            for q, qid, ids, s in scorer.scores(b):
                r, c = np.nonzero((s >= kth[q]) & (ids[:, None] != qid))
                if len(r):
                    best.append(np.stack((qid[c], ids[r], s[r, c])))
                    held += len(r)
                if held > 1 << 18:
                    best = [prune()]
                    held = 0
        t = prune()
        yield pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1]), pa.array(t[2])], ["query_id", "vec_id", "score"])
    return apply


def _search_block(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """Top k of one block of queries, collected as the driver's bounded share."""
    total = len(queries)
    dims = np.array([len(r[1]) for r in queries])
    flat = np.floor(np.concatenate([np.asarray(r[1], np.float64) for r in queries] or [np.zeros(0)]) * 1024)
    scorer = Scorer(np.array([r[0] for r in queries], np.int64), dims, flat, np.concatenate(([0], np.cumsum(dims)[:-1])))
    seen = (vectors.mapInArrow(_ranges(scorer, total), "q long, lo long, hi long, n long")
            .groupBy("q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect())
    lo = np.zeros(total, np.int64)
    hi = np.full(total, -1, np.int64)
    left = np.zeros(total, np.int64)  # rank of the k-th value among scores up to hi
    for r in seen:
        lo[r["q"]], hi[r["q"]], left[r["q"]] = r["lo"], r["hi"], min(k, r["n"])
    while (open_ := hi > lo).any():
        width = np.maximum(1, -((lo - hi - 1) // BINS))
        top = np.where(open_, hi, lo - 1)  # settled queries are not counted again
        rows = (vectors.mapInArrow(_histogram(scorer, lo, top, width), "q long, bin long, n long")
                .groupBy("q", "bin").agg(F.sum("n").alias("n"))
                .select("q", "bin", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))).alias("upto"), "n")
                .join(vectors.sparkSession.createDataFrame(
                    [(int(q), int(left[q])) for q in np.flatnonzero(open_)], "q long, need long"), "q")
                .where("upto >= need and upto - n < need").collect())
        for r in rows:
            q = r["q"]
            left[q] -= r["upto"] - r["n"]
            lo[q] += r["bin"] * width[q]
            hi[q] = min(hi[q], lo[q] + width[q] - 1)
    kth = np.where(left > 0, lo, np.iinfo(np.int64).max)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (vectors.mapInArrow(_above(scorer, kth, k), "query_id long, vec_id long, score long")
            .withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def top_k(embeddings: DataFrame, is_query, k: int = 10, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` greatest scores among
    all rows but its own.

    ``is_query``: condition on vec_id. Query ids are dealt into blocks of at most
    ``query_block``; the loop over blocks runs on the driver, the scoring of a
    block over all rows on the executors."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = store(rows.where(is_query).where("vec_id is not null").where(finite).dropDuplicates(["vec_id"]), "queries")
    out, after = None, None
    while True:
        q = (picked if after is None else picked.where(F.col("vec_id") > after)).orderBy("vec_id").limit(query_block).collect()
        if not q:
            break
        after = q[-1]["vec_id"]
        part = store(_search_block(rows, q, k), "top-k")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
