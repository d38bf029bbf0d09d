import json

from pyspark.sql import functions as F

from threadloom.plans.stages import run_stages
from threadloom.streaming import watch as W


def test_watch_reads_each_file_once(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    report = lambda b: b.groupBy("kind").agg(F.count("*").alias("n"))
    for i in range(2):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"id": f"{i}-{j}", "kind": "k"}) for j in range(3)) + "\nbroken\n")
        W.watched(spark, str(src), "id string, kind string", report, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.n for r in rows if r.kind) == [3, 3]


def test_harvest_resumes_without_repeats(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    for ids in (["a", "b", "a"], ["b", "c"]):
        (src / f"{'-'.join(ids)}.json").write_text("\n".join(json.dumps({"id": i}) for i in ids))
        W.harvested(spark, str(src), "id string", "id", out, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_stages_skip_what_exists(spark, tmp_path):
    calls = []
    stages = [("one", lambda t: calls.append(1) or spark.range(3)), ("two", lambda t: calls.append(2) or t["one"].where("id > 0"))]
    assert run_stages(spark, str(tmp_path), stages)["two"].count() == 2
    assert run_stages(spark, str(tmp_path), stages)["two"].count() == 2 and calls == [1, 2]
