"""Held-out accuracy, gradients, and odd inputs of the classifier."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from shopsignals.llm import mil_quality as Q
from shopsignals.llm.tables import read
from paths import SF


def test_held_out_accuracy(spark):
    d, l = read(spark, SF, "documents"), read(spark, SF, "labels")  # noqa: E741
    model = Q.train(d, l)
    out = Q.score(d, model).join(l, "doc_id").collect()
    test = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == r["quality"] for r in test]) > 0.9
    kept = Q.accepted(d, model)
    assert kept.columns == d.columns and kept.count() == Q.score(d, model).where("predicted = 1").count()


def test_labels_of_the_held_out_part_are_not_learned(spark):
    d, l = read(spark, SF, "documents"), read(spark, SF, "labels")  # noqa: E741
    flipped = l.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(d, l), Q.train(d, flipped)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_attention_finds_the_telling_passage():
    rnd = np.random.default_rng(3)
    count = rnd.integers(1, 6, 40)
    y = rnd.integers(0, 2, 40).astype(np.float32)
    x = rnd.normal(size=(count.sum(), Q.WIDTH)).astype(np.float32)
    x[np.cumsum(count) - 1, 0] += 3 * y  # one passage tells
    m = Q.fit(x, count, y)
    p = m.score(x, count)
    assert np.mean((p > 0.5) == y) > 0.95
    # attention: the passage order of a document does not matter
    assert np.allclose(m.score(x[::-1], count[::-1])[::-1], p, atol=1e-4)


def test_passages_cover_whole_texts():
    import pyarrow as pa

    from shopsignals.llm.kernels import text_buffer

    tx = ["w " * 1000, "", None, " \n", "é" * 10, "a b"]
    x, count = Q.passages(*text_buffer(pa.array(tx)))
    assert count.tolist() == [11, 1, 1, 1, 1, 1] and len(x) == 16 and np.isfinite(x).all()
    one, _ = Q.passages(*text_buffer(pa.array(["a b"])))
    assert np.array_equal(one[0], x[-1])


def test_odd_inputs(spark, docs):
    d = docs([(1, "plain words here", "en", "s", 1), (1, "plain words here", "en", "s", 1), (2, None), (None, ""), (4, "#" * 3_000_000)], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.score(d, Q.train(d, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (4, 7, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, text int")
    assert isinstance(Q.train(d, odd), float)
    both = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = Q.score(d, Q.train(d, both)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert Q.score(docs([]), Q.train(docs([]), both)).collect() == []
