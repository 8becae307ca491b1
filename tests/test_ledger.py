import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rillflow.sources import ledger


def ids(spark, folder, table="t", names=None):
    return sorted(r.id for r in ledger.rows(spark, folder, table, names).collect())


def test_a_run_counts_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "f")
    one = ledger.Run(spark, folder, "one")
    assert one.stage("t", spark.range(10, numPartitions=4)) == 10
    assert one.stage("u", spark.range(0).withColumn("s", F.lit("x"))) == 0
    assert ledger.runs(folder) == []
    with pytest.raises(FileNotFoundError):
        ledger.rows(spark, folder, "t")
    one.publish()
    assert ids(spark, folder) == list(range(10)) and ledger.rows(spark, folder, "u").dtypes == [("id", "bigint"), ("s", "string")]
    # the same run again takes the first one's place, another one stands beside it
    again = ledger.Run(spark, folder, "one")
    again.stage("t", spark.range(5, 12))
    assert ids(spark, folder) == list(range(10))
    again.publish()
    two = ledger.Run(spark, folder, "two")
    two.stage("t", spark.range(2).withColumn("more", F.array(F.lit(1.5))))
    two.publish()
    assert ids(spark, folder) == [0, 1, 5, 6, 7, 8, 9, 10, 11] and ids(spark, folder, names=["two"]) == [0, 1]
    assert ledger.rows(spark, folder, "t").where("more IS NULL").count() == 7
    assert ledger.vacuum(folder) == [one.attempt] and ids(spark, folder) == [0, 1, 5, 6, 7, 8, 9, 10, 11] and ledger.vacuum(folder) == []


def test_types_come_back(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-02-03 04:05:06' AS a, date'2024-01-01' AS b, CAST(1.25 AS DECIMAL(9, 2)) AS c, X'0102' AS d, map('k', 1) AS e, named_struct('x', 1) AS f, CAST(NULL AS STRING) AS g")
    run = ledger.Run(spark, "file://" + str(tmp_path), "r")
    run.stage("t", df)
    run.publish()
    back = ledger.rows(spark, "file://" + str(tmp_path), "t")
    assert back.collect() == df.collect() and back.dtypes == df.dtypes


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path)
    run = ledger.Run(spark, folder, "r")
    with pytest.raises(Exception, match="broken"):
        run.stage("t", spark.range(0, 100, numPartitions=4).withColumn("x", F.expr("IF(id = 99, raise_error('broken'), id)")))
    assert ledger.runs(folder) == [] and not run.tables
    with pytest.raises(ValueError):
        ledger.Run(spark, folder, "a/b")


LOST = """
import os, sys
from pyspark.sql import SparkSession
from rillflow.sources import ledger

folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
ledger.ROW_GROUP = 1

def once_lost(batches):
    for k, batch in enumerate(batches):
        yield batch
        if k == 3 and batch.column(0)[0].as_py() < 100:
            try:
                os.close(os.open(folder + "/lost", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                continue
            os._exit(1)

run = ledger.Run(spark, folder + "/out", "r")
assert run.stage("t", spark.range(0, 300, numPartitions=3).mapInArrow(once_lost, "id long")) == 300
run.publish()
assert sorted(r.id for r in ledger.rows(spark, folder + "/out", "t").collect()) == list(range(300))
print("whole")
"""


def test_a_lost_worker_doubles_nothing(tmp_path):
    """A worker dies in the middle of its partition: the task is tried again, and what the first try wrote is not seen."""
    (tmp_path / "job.py").write_text(LOST)
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    got = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(tmp_path)], env=env, capture_output=True, text=True, timeout=170)
    assert "whole" in got.stdout, got.stderr[-2000:]
    assert (tmp_path / "lost").exists()
