"""What a judge is given is searched for once, however many stages read it."""

from cordonlake.queries import evaluation


def test_a_judged_pool_is_searched_once(spark):
    plan = evaluation._model_grades(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_a_run_is_searched_once(spark):
    plan = evaluation.graded_run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
