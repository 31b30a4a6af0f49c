"""TF-IDF product index and brand search.

The index is a long table (sku_id, term, weight): tf·idf with
idf = ln((1 + N) / (1 + df)) + 1 and rows L2-normalised. A query is answered by
upper bounds per term (``candidate_pairs``): only documents that can beat the
best score known for the query are scored, and postings of terms too common to
matter are not read; no document × document or query × catalog product is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.session import materialize

# tokens of two or more word characters, Unicode-aware
TOKEN_PATTERN = r"(?U)\b\w\w+\b"


def default_stop_words(spark) -> list[str]:
    """English stop words shipped with Spark ML (StopWordsRemover)."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def search_text(catalog: DataFrame) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
             ("product_name", "brand", "category", "subcategory")]
    return F.lower(F.concat_ws(" ", *parts))


def tokens(text: Column, stop_words: list[str]) -> Column:
    toks = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)
    if stop_words:
        sw = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
        toks = F.filter(toks, lambda t: ~F.array_contains(sw, t))
    return toks


def tfidf_index(catalog: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(sku_id, term, weight) with L2-normalised tf-idf weights."""
    sw = default_stop_words(catalog.sparkSession) if stop_words is None else stop_words
    docs = catalog.select("sku_id", tokens(search_text(catalog), sw).alias("toks"))
    n_docs = catalog.select(F.count(F.lit(1))).scalar()
    tf = docs.select("sku_id", F.explode("toks").alias("term")).groupBy("sku_id", "term") \
             .agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, "term").withColumn(
        "raw", F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("sku_id")))
    return w.select("sku_id", "term", (F.col("raw") / norm).alias("weight"), "df")


def query_vectors(queries: DataFrame, index: DataFrame, n_docs, stop_words: list[str]) -> DataFrame:
    """Query (qid, query) → (qid, term, qweight), idf from the index vocabulary."""
    q = queries.select("qid", F.explode(tokens(F.lower(F.col("query")), stop_words)).alias("term"))
    q = q.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = index.select("term", "df").distinct()
    q = q.join(vocab, "term").withColumn("raw", F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("qid")))
    return q.select("qid", "term", (F.col("raw") / norm).alias("qweight"))


LEVELS = 64  # impact levels that a term's postings are cut into
SLACK = 1e-9  # scores this close are compared, not pruned


def first_guess(index: DataFrame, qv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds, best): per query and term the most it can add to a score (qid, term,
    qweight, ub), and per query the best score among each term's strongest document."""
    strongest = index.groupBy("term").agg(F.max("weight").alias("top"), F.min_by("sku_id", F.struct(-F.col("weight"), "sku_id")).alias("sku_id"))
    bounds = qv.join(strongest, "term").withColumn("ub", F.col("qweight") * F.col("top"))
    best = pair_scores(bounds.select("qid", "sku_id").distinct(), index, qv).groupBy("qid").agg(F.max("score").alias("best"))
    return bounds.drop("top", "sku_id"), best


def candidate_pairs(index: DataFrame, qv: DataFrame, min_score: float) -> DataFrame:
    """(qid, sku_id) of all documents that can be a query's best at ``min_score`` or more.

    Terms are taken from the weakest bound up: while their bounds together stay
    below the score already found, a document with no other term of the query
    cannot win, so postings of these terms (the common ones) are never read. Of
    the others only the impact levels are read whose weight, with all that the
    remaining terms could add, reaches that score.
    """
    bounds, best = first_guess(index, qv)
    by = Window.partitionBy("qid")
    need = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(min_score)) - SLACK
    essential = (bounds.join(best, "qid", "left").withColumn("need", need)
                 .withColumn("upto", F.sum("ub").over(by.orderBy("ub", "term"))).withColumn("all", F.sum("ub").over(by))
                 .where(F.col("upto") >= F.col("need"))
                 .select("qid", "term", ((F.col("need") - (F.col("all") - F.col("ub"))) / F.col("qweight")).alias("least")))
    postings = index.select("term", F.floor(F.col("weight") * LEVELS).alias("level"), "sku_id", "weight")
    levels = postings.groupBy("term", "level").agg(F.max("weight").alias("most"))
    wanted = essential.join(levels, "term").where("most >= least").select("qid", "term", "level", "least")
    return wanted.join(postings, ["term", "level"]).where("weight >= least").select("qid", "sku_id").distinct()


def pair_scores(pairs: DataFrame, index: DataFrame, qv: DataFrame) -> DataFrame:
    """The cosine of each (qid, sku_id)."""
    return (pairs.join(index.select("sku_id", "term", "weight"), "sku_id").join(qv, ["qid", "term"])
            .groupBy("qid", "sku_id").agg(F.sum(F.col("qweight") * F.col("weight")).alias("score")))


def brand_search(catalog: DataFrame, queries: DataFrame, n: int = 10, min_score: float = 0.05,
                 stop_words: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Best-matching product (cosine ≥ ``min_score``) → its brand's top n
    by reviews. Queries with no match return no rows.

    Output (qid, detected_sku, brand, best_score, rank, rec_sku).
    """
    sw = default_stop_words(catalog.sparkSession) if stop_words is None else stop_words
    idx = materialize(index if index is not None else tfidf_index(catalog, sw))
    n_docs = catalog.select(F.count(F.lit(1))).scalar()
    qv = materialize(query_vectors(queries, idx, n_docs, sw))
    scores = pair_scores(candidate_pairs(idx, qv, min_score), idx, qv)
    # arg-max per query; ties → lowest sku_id (first catalog row). Equal
    # scores can differ in the last bits with the summation order, so the
    # comparison uses the score rounded to 12 digits.
    key = F.struct((-F.round(F.col("score"), 12)).alias("ns"), F.col("sku_id"))
    best = scores.groupBy("qid").agg(F.min_by(F.struct("sku_id", "score"), key).alias("b"))
    best = best.select("qid", F.col("b.sku_id").alias("detected_sku"), F.col("b.score").alias("best_score")) \
               .where(F.col("best_score") >= min_score)
    brands = catalog.select(F.col("sku_id").alias("detected_sku"), F.lower("brand").alias("_lb"), "brand")
    best = best.join(brands, "detected_sku")
    per_brand = catalog.select("sku_id", F.lower("brand").alias("_lb"), "review_count")
    from shopsignals.operators.topk import top_k_per_group

    top = top_k_per_group(per_brand, ["_lb"], [F.col("review_count").desc(), F.col("sku_id")], n)
    out = best.join(top, "_lb")
    return out.select("qid", "detected_sku", "brand", "best_score", "rank", F.col("sku_id").alias("rec_sku"))


# ------------------------------------------------------------- B11, B14 in bulk
GRAM = 8  # longest run of characters that postings are kept of
CHUNK = 1024  # keys or query ids that stand in one row
TASK_ROWS = 2_000_000  # rows of the answer that one task writes out


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    n = F.length(text) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))) \
            .otherwise(F.array().cast("array<string>"))


def _alike(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Keys with the same set of texts stand for each other: (class, ``key``) of
    every key, and the distinct (class, ``text``). A class is known by 128 bits
    and the size of the set."""
    rows = rows.select(F.struct(key).alias("_k"), text)
    bits = [F.bit_xor(F.xxhash64(F.lit(s), text)) for s in (1, 2)]
    member = rows.groupBy("_k").agg(F.struct(*[b.alias(f"h{i}") for i, b in enumerate(bits)], F.count(F.lit(1)).alias("n")).alias("_class"))
    member = materialize(member)
    of = member.groupBy("_class").agg(F.min("_k").alias("_k"))
    return member.select("_class", F.col(f"_k.{key}").alias(key)), materialize(rows.join(of, "_k").select("_class", text))


def _in_chunks(member: DataFrame, cls: str, key: str) -> DataFrame:
    """(class, list of at most about 2 * CHUNK keys), large classes in many rows."""
    many = member.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / CHUNK)).alias("_part")
    return (member.join(many, "_class").select(F.col("_class").alias(cls), part, "_n", key).groupBy(cls, "_part", "_n")
            .agg(F.collect_list(F.struct(key)).alias(f"{key}_list")))


def _expand(pairs: DataFrame, first: DataFrame, on: str, second: DataFrame, by: str, volume: DataFrame) -> DataFrame:
    """Pairs of classes -> rows: lists of ``first`` go to the pairs, the pairs to
    the lists of ``second``, a class of many answers to as many copies of its lists
    as tasks are to write them out."""
    tasks = volume.select(by, F.ceil(F.col("_rows") / TASK_ROWS).cast("int").alias("_tasks"))
    left = (pairs.join(first.drop("_n"), on).join(tasks, by)
            .withColumn("_task", F.pmod(F.xxhash64(on, "_part"), F.col("_tasks")).cast("int")))
    right = second.drop("_n", "_part").join(tasks, by).select("*", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"))
    return left.drop("_tasks").join(right.drop("_tasks"), [by, "_task"])


def search_many(df: DataFrame, key: str, cols: list[str], queries: DataFrame) -> DataFrame:
    """B11/B14 for a table of queries (qid, q): (qid, ``key``) of every row with
    ``q`` in one of ``cols``, any case, literally.

    Texts are found by postings of runs of 8 characters: each query is looked up by
    its rarest run only, then the texts of these rows are compared. Shorter queries
    are looked up by postings of their own length; NULL and empty ones find
    nothing. Rows without a key are not found; a key's rows count as one.

    Keys of the same texts and ids of the same queries are looked up once, as
    classes, and the answer, which can be much larger than both tables, is
    written out by the last join from lists of ids: it crosses no shuffle.
    """
    asked = queries.select("qid", F.lower(F.col("q").cast("string")).alias("q")).where("q <> ''").distinct()
    ids, wanted = _alike(asked, "qid", "q")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode(F.array(*[F.lower(F.col(c).cast("string")) for c in cols])).alias("text"))
    keys, texts = _alike(rows.where("text is not null").distinct(), "_key", "text")
    wanted = wanted.select(F.col("_class").alias("_q"), "q", F.least(F.length("q"), F.lit(GRAM)).alias("size"))
    texts = texts.withColumnRenamed("_class", "_doc")
    sizes = sorted(s for s in wanted.agg(F.collect_set("size")).first()[0])  # at most eight
    if not sizes:
        return asked.select("qid", F.lit(None).cast(df.schema[key].dataType).alias(key)).limit(0)
    of_query = F.lit(None).cast("array<string>")
    for s in sizes:
        of_query = F.when(F.col("size") == s, _grams(F.col("q"), s)).otherwise(of_query)
    q = wanted.select("q", "size").distinct()
    used = materialize(q.select("q", F.explode(of_query).alias("gram")))
    each = F.concat(*[_grams(F.col("text"), s) for s in sizes])
    postings = texts.select("_doc", F.explode(each).alias("gram")).join(used.select("gram").distinct(), "gram", "left_semi")
    postings = materialize(postings.distinct())
    often = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram without postings is the rarest: the query finds nothing
    rarest = (used.join(often, "gram", "left").groupBy("q")
              .agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
              .where("r.n is not null").select("q", F.col("r.gram").alias("gram")))
    found = postings.join(rarest, "gram")
    whole = found.where(F.length("q") <= GRAM).select("q", "_doc")  # the run is the query
    longer = found.where(F.length("q") > GRAM).join(texts, "_doc").where(F.contains(F.col("text"), F.col("q"))).select("q", "_doc")
    pairs = materialize(whole.unionByName(longer).join(wanted.select("_q", "q"), "q").select("_q", "_doc").distinct())
    ids, keys = (materialize(_in_chunks(m, c, k)) for m, c, k in ((ids, "_q", "qid"), (keys, "_doc", "_key")))
    sizes_of = [m.select(c, F.col("_n").alias(n)).distinct() for m, c, n in ((ids, "_q", "_ids"), (keys, "_doc", "_keys"))]
    pairs = materialize(pairs.join(sizes_of[0], "_q").join(sizes_of[1], "_doc"))
    # of each pair the shorter list travels
    out = []
    for fewer, first, on, second, by in (("_keys <= _ids", keys, "_doc", ids, "_q"), ("_keys > _ids", ids, "_q", keys, "_doc")):
        some = pairs.where(fewer)
        volume = some.groupBy(by).agg(F.sum(F.col("_ids") * F.col("_keys")).alias("_rows"))
        out.append(_expand(some.select("_q", "_doc"), first, on, second, by, volume).select("qid_list", "_key_list"))
    out = out[0].unionByName(out[1])
    out = out.select(F.explode("qid_list").alias("_a"), "_key_list").select("_a", F.explode("_key_list").alias("_b"))
    return out.select(F.col("_a.qid").alias("qid"), F.col("_b._key").alias(key))
