"""Streaming evaluation: restart from the checkpoint processes only new
uploads (exactly once into the sink), and the running matrix covers all."""

import os

import pytest
from pyspark.sql import functions as F

from rulescope.operators import views as V
from rulescope.operators.rules import evaluate
from rulescope.plans.queries import pack_q
from rulescope.streaming.stream import append_evaluated, evaluate_stream, read_uploads, latest_matrix, running_matrix
from tests.conftest import SF_SMALL


def test_restart_processes_only_new_uploads(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    landing, sink, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "sink", "ckpt"))
    first = orders.where(F.col("o_orderstatus") == "F")
    rest = orders.where(F.col("o_orderstatus") != "F")
    first.write.parquet(os.path.join(landing, "upload1"))

    def run():
        # the landing folder holds one sub-folder per upload
        stream = read_uploads(spark, landing, orders.schema, glob="*.parquet", recursive=True)
        ev = evaluate_stream(stream, pack_q())
        q = append_evaluated(ev, sink, ckpt, columns=["o_orderkey", *ev.fail_cols, ev.total_col])
        q.awaitTermination()

    run()
    assert spark.read.parquet(sink).count() == first.count()
    rest.write.parquet(os.path.join(landing, "upload2"))
    run()  # same checkpoint: only the new upload is read
    out = spark.read.parquet(sink)
    assert out.count() == orders.count() and out.select("o_orderkey").distinct().count() == orders.count()
    batch = evaluate(orders, pack_q()).df.select("o_orderkey", "_TOTAL_FAILS")
    assert out.select("o_orderkey", "_TOTAL_FAILS").exceptAll(batch).count() == 0


def test_running_matrix_matches_batch(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    ev = evaluate_stream(read_uploads(spark, SF_SMALL, orders.schema, glob="orders.parquet"), pack_q())
    sink, ckpt = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "mc")
    running_matrix(ev, ["o_orderstatus"], sink, ckpt).awaitTermination()
    got = sorted(tuple(r) for r in latest_matrix(spark, sink).collect())
    want = sorted(tuple(r) for r in V.matrix(evaluate(orders, pack_q()), ["o_orderstatus"]).collect())
    assert got == want


def test_running_matrix_shows_whole_results_only(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    sink = os.path.join(tmp_dir, "whole")
    with pytest.raises(ValueError):
        latest_matrix(spark, sink)
    ev = evaluate_stream(read_uploads(spark, SF_SMALL, orders.schema, glob="orders.parquet"), pack_q())
    running_matrix(ev, ["o_custkey"], sink, os.path.join(tmp_dir, "wholec")).awaitTermination()
    whole = latest_matrix(spark, sink)
    assert whole.count() == orders.select("o_custkey").distinct().count()
    assert len(whole.inputFiles()) > 1  # written by its own tasks
    # A later result that was not finished is not shown.
    whole.limit(3).write.parquet(f"{sink}/epoch=99")
    assert latest_matrix(spark, sink).count() == whole.count()
