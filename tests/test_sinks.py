"""Distributed reports: equal to the ones in one file, whole or not there at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scansmith import export, sinks
from scansmith.plans.scan import scan

TEXT = 'fetch("/api/v1/users?b=1&a=2"); u="https://svc.acme.io/api/v2/x"; m="ops@acme.io"; k="AKIA' + "ABCDEFGHIJKLMNOP" + '"; x="/admin"'


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(f"f{i}.js", TEXT.replace("users", f'u{i % 7}"')) for i in range(40)], "source string, text string")
    return scan(docs).cache()


def whole(path):
    return b"".join(sinks.document(path)).decode()


def test_reports_are_those_of_one_file(spark, found, tmp_path):
    sinks.write_sarif(found, f"{tmp_path}/sarif")
    assert json.loads(whole(f"{tmp_path}/sarif")) == json.loads("".join(export.sarif(found)))
    sinks.write_postman(found, f"file://{tmp_path}/postman", "https://acme.io")
    assert json.loads(whole(f"{tmp_path}/postman")) == json.loads("".join(export.postman(found, "https://acme.io")))
    sinks.write_json_report(found, {"target": 'a "b"'}, f"{tmp_path}/json")
    assert json.loads(whole(f"{tmp_path}/json")) == json.loads("".join(export.json_report(found, {"target": 'a "b"'})))
    index = sinks.index_of(f"{tmp_path}/json")
    assert sum(p["rows"] for p in index["parts"]) == found.count()
    assert [os.path.getsize(f) for f in index["files"]] == [p["bytes"] for p in index["parts"]]


def test_no_findings_and_a_later_report(spark, found, tmp_path):
    sinks.write_json_report(found.limit(0), {}, f"{tmp_path}/r")
    assert json.loads(whole(f"{tmp_path}/r")) == {"meta": {}, "findings": {}}
    sinks.write_sarif(found.limit(0), f"{tmp_path}/r")
    assert json.loads(whole(f"{tmp_path}/r"))["runs"][0]["results"] == []
    with pytest.raises(Exception, match="one column"):
        sinks.write_parts(found.select("source", "value"), f"{tmp_path}/r")


def test_a_failed_run_leaves_the_report_before(spark, tmp_path):
    path = f"{tmp_path}/r"
    rows = spark.range(1000).repartition(4).select(F.col("id").cast("string").alias("s"))
    sinks.write_parts(rows, path, "[", "]", ",")
    before = whole(path)
    assert len(sinks.index_of(path)["parts"]) == 4
    assert sorted(json.loads(before)) == list(range(1000))
    broken = rows.select(F.when(F.col("s") == "777", F.raise_error(F.lit("lost"))).otherwise(F.col("s")).alias("s"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_parts(broken, path, "[", "]", ",")
    assert whole(path) == before and len(os.listdir(path)) == 2  # one run and the pointer


def test_fragments_of_lost_attempts_go_at_the_commit(tmp_path):
    writer = sinks._Writer(str(tmp_path), "<", ">", "")
    os.makedirs(f"{tmp_path}/{writer.run}")
    for name in ("000000-a", "000001-b", "000001-dead"):
        with open(f"{tmp_path}/{writer.run}/{name}", "w") as out:
            out.write(name[-1])
    writer.commit([sinks._Fragment(1, "000001-b", 1, 1), None, sinks._Fragment(0, "000000-a", 1, 1)])
    assert whole(str(tmp_path)) == "<ab>" and "000001-dead" not in os.listdir(f"{tmp_path}/{writer.run}")
