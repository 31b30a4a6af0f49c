"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

A document d of source s is used at a rate r_d between 0 and ``cap``. Among all
rates with sum(r_d * size_d) = target_s the mix takes those nearest to 1 in
relative entropy. They are exponentially tilted: r_d = min(cap, exp(u_s * x_d)),
x_d being the size over its source's mean size, and u_s maximises a concave
dual per source. Newton's iterations on u_s are grouped sums over the whole
table; a step that leaves the bracket known to hold u_s is halved into it. The
sums need sizes only, so they run on (source, size, documents) counts.

Rates become copies by systematic rounding: the documents of a source lie in
order of size on a line, each as long as its rate, and a document takes as many
copies as integers fall on its length. Neighbours have about equal sizes, so
the words taken stay within about one document of the target; where many
documents share a size, each ``BLOCK`` of them adds at most one copy more or
less, in either direction.

Results in cases of doubt: null text has size 0; a document of size 0 takes 0
words; null is a source of its own, after all others; further columns are
ignored or, in ``resample``, kept; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.llm.tables import store

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
ITERATIONS = 24  # most Newton steps; a step that halves the bracket counts too
TOLERANCE = 1e-7  # of the target
BLOCK = 512  # documents of one size ranked together
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size, n) counts.

    Target: min(cap * source_size, weight * level), where targets sum to
    ``share`` of all sizes; resharing the excess of full sources by weight ends
    there. Sources fill up in order of limit / weight, so the level is the one
    at the first source that stays within its limit. The two orders over
    sources run in one task: one row a source."""
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = (s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                             (F.pmod(n, F.lit(len(weights))) + 1).cast("int")))
         .withColumn("limit", F.lit(cap) * F.col("source_size")))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("place", F.row_number().over(order))
         .withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    within = F.col("limit") >= F.col("weight") * F.col("level")
    s = s.withColumn("open", F.min(F.when(within, F.struct("place", "level"))).over(whole))
    return s.select("source", "source_size", F.when(F.col("place") >= F.col("open.place"), F.col("weight") * F.col("open.level"))
                    .otherwise(F.col("limit")).alias("target"))


def _tilts(sizes: DataFrame, cap: float) -> DataFrame:
    """source, source_size, target, mean, tilt: the dual optimum of every source
    (null: all documents at the cap, or none wanted)."""
    mean = sizes.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    t = targets(sizes, cap=cap)
    t = t.join(mean.withColumnRenamed("source", "_s"), t["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    inside = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size"))
    # at the ends of the bracket no document, or every one, is past the target
    state = store(t.select(
        "source", "source_size", "target", "mean", F.when(inside, F.lit(0.0)).alias("tilt"),
        (F.least(F.lit(0.0), F.log(F.try_divide(F.col("target"), F.col("source_size")))) * F.col("mean") - 1).alias("lo"),
        (F.log(F.lit(cap)) * F.col("mean") + 1).alias("hi"), F.when(inside, F.lit(1.0)).alias("miss")), "tilt")
    for _ in range(ITERATIONS * 2):
        if not (state.agg(F.max(F.abs("miss"))).first()[0] or 0.0) > TOLERANCE:
            break
        x = F.col("size") / F.col("mean")
        grown = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        words = F.col("size") * F.col("n")
        part = state.where("tilt is not null").select(F.col("source").alias("_s"), "mean", "tilt")
        sums = (sizes.join(part, sizes["source"].eqNullSafe(part["_s"]))
                .groupBy("_s").agg(F.sum(words * F.least(grown, F.lit(cap))).alias("taken"),
                                   F.sum(F.when(grown < cap, words * x * grown)).alias("slope"),
                                   F.count(F.lit(1)).alias("seen")))
        now = state.join(sums, state["source"].eqNullSafe(sums["_s"]), "left")
        over = F.col("taken") - F.col("target")
        lo = F.when(over < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(over > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - F.try_divide(over, F.col("slope"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        miss = F.try_divide(over, F.col("target"))
        met = F.abs(miss) <= TOLERANCE
        state = store(now.select("source", "source_size", "target", "mean",
                                 F.when(met, F.col("tilt")).otherwise(step).alias("tilt"),
                                 lo.alias("lo"), hi.alias("hi"), miss.alias("miss")), "tilt")
    return state.select("source", "source_size", "target", "mean", F.round("tilt", 9).alias("tilt"))


def _classes(sizes: DataFrame, cap: float) -> DataFrame:
    """Per (source, size): n, rate, and where its documents begin on the line."""
    tilts = _tilts(sizes, cap)
    c = sizes.join(tilts.withColumnRenamed("source", "_s"), sizes["source"].eqNullSafe(F.col("_s")))
    full = F.when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("tilt").isNull(), full).otherwise(
        F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(cap)))
    c = c.withColumn("rate", rate)
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("source", "size", "n", "rate", "source_size", "target",
                    F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)).alias("begin"))


def mix(documents: DataFrame, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document."""
    docs = store(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = store(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    c = store(_classes(sizes, cap), "rates").withColumnRenamed("source", "_s").withColumnRenamed("size", "_size")
    d = docs.join(c, docs["source"].eqNullSafe(c["_s"]) & (docs["size"] == c["_size"]))
    blocks = F.ceil(F.col("n") / BLOCK)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks))
    # a class of one block begins where the class before ended; more blocks are
    # set out evenly, each on its own line
    u = F.col("begin") + F.col("block") * 0.6180339887498949
    u = u - F.floor(u)
    k = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("doc_id")) - 1
    d = d.withColumn("k", k)
    copies = F.floor(u + (F.col("k") + 1) * F.col("rate")) - F.floor(u + F.col("k") * F.col("rate"))
    return d.select("doc_id", "source", "size", "source_size", "target",
                    F.least(copies, F.lit(int(cap))).cast("long").alias("copies"))


def taken_words(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes."""
    return mix(documents).select("doc_id", "size", "source_size", "target",
                                 (F.col("copies") * F.col("size")).alias("taken"))


def resample(documents: DataFrame, cap: float = 2.0) -> DataFrame:
    """The documents, each as many times as the mix has copies of it. Rows that
    repeat a doc_id of one source and size share their copies, rounded."""
    m = (mix(documents, cap).groupBy("doc_id", "source", "size")
         .agg(F.round(F.avg("copies")).cast("int").alias("_copies"))
         .where("_copies > 0")
         .select(*[F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "source", "size")], "_copies"))
    d = documents
    return (d.join(m, d["doc_id"].eqNullSafe(m["_mix_doc_id"]) & d["source"].eqNullSafe(m["_mix_source"])
                   & (word_count(d["text"]) == m["_mix_size"]))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*[d[c] for c in d.columns]))
