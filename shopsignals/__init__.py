"""shopsignals — Spark-native pricing and personalization operators.

Everything here is a DataFrame-in / DataFrame-out function. Relational work is
expressed with the DataFrame API so Catalyst can prune columns, push filters to
the Parquet scan and pick join strategies; AQE handles partition sizing and
skewed keys at run time.
"""

from shopsignals.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
