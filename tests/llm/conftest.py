import pytest

CLEAN = "spark.sql.shuffle.partitions"


@pytest.fixture()
def docs(spark):
    """Build a documents table from texts, with 8 partitions."""
    def make(rows, extra=False):
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                               T.StructField("n_chars", T.LongType())])
        full = [(r + (None,) * 5)[:5] if isinstance(r, tuple) else r for r in rows]
        df = spark.createDataFrame(full, schema).repartition(4)
        if extra:  # names that operators use inside
            for c in ("doc", "spans", "s", "n", "a", "h", "size", "kept", "label", "score"):
                df = df.withColumn(c, df["doc_id"].cast("string"))
        return df
    return make
