"""Plan guards: no registered query plans a cross join."""

from tests.conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402

# model-fitting queries train GBTs while building; their plans are model transforms
MODEL_QUERIES = {"j10_predict_factor", "j7_model_metrics", "j9_feature_importance", "j3_time_model",
                 "j10_coarse_model"}


def test_no_query_plans_a_cross_join(spark):
    bad = {}
    for name, fn in sorted(E.queries().items()):
        if name in MODEL_QUERIES:
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert not bad
