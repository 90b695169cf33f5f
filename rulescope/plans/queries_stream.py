"""Streaming queries: the driver's ``orders`` file read as an upload stream."""

from __future__ import annotations

from rulescope.plans.queries import EV_ORDERS, Q_CRITS, Q_FAILS, Q_NAMES, pack_q, register, table
from rulescope.plans.oracle import d_pct_text
from rulescope.session import shared_path
from rulescope.streaming.stream import append_evaluated, evaluate_stream, read_uploads, latest_matrix, running_matrix


def _orders_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "orders").schema
    return read_uploads(spark, sf_dir, schema, glob="orders.parquet")


@register(
    "stream_rule_eval",
    f"WITH {EV_ORDERS}\nSELECT o_orderkey, {', '.join(Q_FAILS)}, {', '.join(Q_CRITS)}, _TOTAL_FAILS, _IS_OK FROM ev",
)
def stream_rule_eval(spark, sf_dir):
    """Uploads evaluated as they arrive and appended to a Parquet sink."""
    ev = evaluate_stream(_orders_stream(spark, sf_dir), pack_q())
    sink, ckpt = shared_path(spark, "stream-eval"), shared_path(spark, "stream-eval-ckpt")
    cols = ["o_orderkey", *ev.fail_cols, *ev.crit_cols, ev.total_col, ev.ok_col]
    q = append_evaluated(ev, sink, ckpt, columns=cols)
    q.awaitTermination()
    return spark.read.parquet(sink)


@register(
    "stream_matrix",
    f"""WITH {EV_ORDERS}, g AS (
  SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS t, count_if(_IS_OK)::BIGINT AS k,
         {', '.join(f'count_if(FAIL_{n})::BIGINT AS {n}' for n in Q_NAMES)}
  FROM ev GROUP BY o_orderstatus, o_orderpriority)
SELECT o_orderstatus, o_orderpriority, t AS total_sites, k AS ok_sites,
       {d_pct_text('k', 't')} AS ok_pct, t - k AS deficient_sites,
       {d_pct_text('t - k', 't')} AS deficient_pct, {', '.join(Q_NAMES)}
FROM g""",
)
def stream_matrix(spark, sf_dir):
    """Running deficiency matrix over everything received."""
    ev = evaluate_stream(_orders_stream(spark, sf_dir), pack_q())
    sink, ckpt = shared_path(spark, "stream-matrix"), shared_path(spark, "stream-matrix-ckpt")
    q = running_matrix(ev, ["o_orderstatus", "o_orderpriority"], sink, ckpt)
    q.awaitTermination()
    return latest_matrix(spark, sink)
