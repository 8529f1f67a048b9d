"""Shape of the physical plan: what is shuffled, broadcast, pushed down and evaluated once."""

from stmtwatch.operators import alerts as al
from stmtwatch.operators.session import with_session_context
from stmtwatch.plans import catalog, demo
from stmtwatch.plans.scoring import score_log
from stmtwatch.sources.storage import scratch_folder


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _spine(df) -> list[str]:
    """The operators between the result and the scan of the log."""
    node = df._jdf.queryExecution().executedPlan()
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    names = []
    while True:
        names.append(node.nodeName())
        if node.children().isEmpty():
            assert "parquet" in names[-1]
            return names
        node = node.children().head()


def _stored_log(spark, sf_dir):
    path = scratch_folder(spark)
    demo.query_log(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_scoring_neither_shuffles_the_log_nor_leaves_the_jvm(spark, sf_dir):
    scored = score_log(_stored_log(spark, sf_dir), catalog.context(spark))
    plan = _plan(scored)
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") >= 3
    assert not any("Exchange" in name for name in _spine(scored))


def test_filters_on_the_log_reach_the_scan(spark, sf_dir):
    log = _stored_log(spark, sf_dir).filter("proxy_id = 1")
    plan = _plan(score_log(log, catalog.context(spark)).select("risk"))
    assert "EqualTo(proxy_id,1)" in plan
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "user_ip" not in scan.split("ReadSchema")[1]


def test_costly_columns_are_evaluated_once(spark, sf_dir):
    """A filter on the verdict does not copy the expressions it depends on."""
    scored = score_log(_stored_log(spark, sf_dir), catalog.context(spark))
    plan = _plan(al.alerts(scored).filter("risk > 30"))
    assert plan.count("regexp_extract_all(CASE WHEN NOT listed") == 1


def test_generated_methods_are_small_enough_for_the_jit_compiler(spark, sf_dir):
    log = _stored_log(spark, sf_dir)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else nothing is generated before it runs
    try:
        plan = score_log(log, catalog.context(spark))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    generated = debug.codegenStringSeq(plan)
    sizes = [generated.apply(i)._3().maxMethodCodeSize() for i in range(generated.size())]
    assert 0 < max(sizes) < 8000, sizes


def test_groups_are_aggregated_before_the_shuffle(spark, sf_dir):
    raised = al.alerts(score_log(_stored_log(spark, sf_dir), catalog.context(spark)))
    plan = _plan(al.alert_groups(raised))
    assert "partial_max" in plan


def test_session_context_shuffles_the_log_once(spark, sf_dir):
    spine = _spine(with_session_context(demo.session_log(spark, sf_dir)))
    assert spine.count("Exchange") == 1 and spine.count("Window") == 1
