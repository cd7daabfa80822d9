import pytest

from lodestar.sources.runs import Run


def put(spark, path, rows):
    spark.createDataFrame(rows, "k long, v string").write.mode("overwrite").parquet(path)


def two_stages(spark, tmp_path, seen, broken=False, parameters=None):
    run = Run(spark, f"file://{tmp_path}/runs", "r1", [f"file://{tmp_path}/in"], parameters)

    def first():
        seen.append("first")
        return spark.read.parquet(f"file://{tmp_path}/in")

    def second():
        seen.append("second")
        if broken:
            raise RuntimeError("broken")
        return a.groupBy("v").count()

    a = run.stage("first", first)
    return run, sorted(map(tuple, run.stage("second", second).collect()))


def test_a_broken_run_goes_on(spark, tmp_path):
    put(spark, f"file://{tmp_path}/in", [(1, "a"), (2, "a"), (3, "b")])
    seen: list = []
    with pytest.raises(RuntimeError):
        two_stages(spark, tmp_path, seen, broken=True)
    run, rows = two_stages(spark, tmp_path, seen)
    assert rows == [("a", 2), ("b", 1)] and seen == ["first", "second", "second"] and run.read == ["first"] and run.made == ["second"]
    assert two_stages(spark, tmp_path, seen)[1] == rows and len(seen) == 3


def test_what_has_changed_is_made_again(spark, tmp_path):
    put(spark, f"file://{tmp_path}/in", [(1, "a")])
    seen: list = []
    assert two_stages(spark, tmp_path, seen)[1] == [("a", 1)]
    put(spark, f"file://{tmp_path}/in", [(1, "c")])
    assert two_stages(spark, tmp_path, seen)[1] == [("c", 1)] and len(seen) == 4
    assert two_stages(spark, tmp_path, seen, parameters={"k": 2})[1] == [("c", 1)] and len(seen) == 6


def test_a_stage_that_breaks_while_it_is_written_is_not_read(spark, tmp_path):
    put(spark, f"file://{tmp_path}/in", [(1, "a")])
    run = Run(spark, f"file://{tmp_path}/runs", "r2", [f"file://{tmp_path}/in"])
    bad = lambda: spark.range(3).selectExpr("assert_true(id < 2, 'broken')", "id")
    with pytest.raises(Exception, match="broken"):
        run.stage("s", bad)
    again = Run(spark, f"file://{tmp_path}/runs", "r2", [f"file://{tmp_path}/in"])
    assert again.stage("s", lambda: spark.range(3)).count() == 3 and again.made == ["s"]
    with pytest.raises(ValueError):
        Run(spark, f"file://{tmp_path}/runs", "../x", [])
