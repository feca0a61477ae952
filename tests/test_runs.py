"""Runs with a log: what fails is told and stops nothing, and the next run makes what is missing only."""

import os

import pytest
from pyspark.sql import functions as F

from sightline.sources.runlog import RunLog, carried_out


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "log"), str(tmp_path / "out")


def tasks(spark, n, state="a"):
    t = spark.range(n).select(F.format_string("%02d_x.kml", "id").alias("filename"), F.lit(state).alias("state_hash"), "id")
    return t.withColumn("error", F.when(F.col("id") == 3, "no place"))


def produce(poisoned, asked=None):
    def run(part):
        if asked is not None:
            asked.append(part.count())
        content = F.when(F.col("id").isin(poisoned), F.raise_error(F.concat(F.lit("poisoned "), "id"))).otherwise(F.concat(F.lit("c"), "id"))
        return part.where("id <> 5").select("filename", content.cast("string").alias("content"))

    return run


@pytest.mark.parametrize("together", [1000, 4])
def test_a_poisoned_task_is_told_and_the_next_run_makes_up_for_it(spark, place, together):
    log, path = RunLog(spark, place[0]), place[1]
    assert carried_out(tasks(spark, 20), produce([7, 11]), log, path, together) == 20
    state = {r.filename: r for r in log.latest().collect()}
    assert len(state) == 20 and {f for f, r in state.items() if r.status == "failed"} == {"03_x.kml", "07_x.kml", "11_x.kml"}
    assert state["03_x.kml"].error == "no place" and "poisoned 11" in state["11_x.kml"].error and state["05_x.kml"].status == "empty"
    seen = sorted(f for f in os.listdir(path) if f[0] != "_")
    assert seen == sorted(f for f, r in state.items() if r.status == "done") and len(seen) == 16
    asked = []
    assert carried_out(tasks(spark, 20), produce([], asked), log, path, together) == 3 and sum(asked) == 2  # the one without a place is not asked for
    assert {r.filename for r in log.latest().where("status = 'failed'").collect()} == {"03_x.kml"} and len([f for f in os.listdir(path) if f[0] != "_"]) == 18


def test_a_run_again_makes_nothing_and_a_new_state_everything(spark, place):
    log, path = RunLog(spark, place[0]), place[1]
    sound = lambda n, state="a": tasks(spark, n, state).withColumn("error", F.lit(None).cast("string"))
    carried_out(sound(6), produce([]), log, path)
    asked = []
    assert carried_out(sound(6), produce([], asked), log, path) == 0 and not sum(asked)
    assert carried_out(sound(8), produce([], asked), log, path) == 2
    assert carried_out(sound(8, "b"), produce([]), log, path) == 8
    assert carried_out(sound(0), produce([]), log, path) == 0


def test_what_is_not_logged_is_made_again(spark, place):
    """A run that is broken off after its files appeared and before its log: the files are the same after the next one."""
    log, path = RunLog(spark, place[0]), place[1]
    carried_out(tasks(spark, 6), produce([]), RunLog(spark, place[0] + "-lost"), path)
    before = sorted(os.listdir(path))
    assert carried_out(tasks(spark, 6), produce([]), log, path) == 6 and sorted(os.listdir(path)) == before


def test_outputs_of_one_name_are_told_and_stop_nothing(spark, place):
    """Halves never tell them apart, so a job that failed by them went on halving to the last."""
    log, path = RunLog(spark, place[0]), place[1]
    t = tasks(spark, 20).withColumn("error", F.lit(None).cast("string")).withColumn("filename", F.when(F.col("id").isin(8, 9), F.lit("one.kml")).otherwise(F.col("filename")))
    asked = []
    carried_out(t, produce([], asked), log, path)
    state = {r.filename: r for r in log.latest().collect()}
    assert len(asked) == 1 and state["one.kml"].status == "failed" and "file name" in state["one.kml"].error
    assert {f for f, r in state.items() if r.status == "done"} == {f for f in os.listdir(path) if f[0] != "_"} and len(state) == 19
