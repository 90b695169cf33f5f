"""rulescope: rule-driven health analytics for row-per-entity tables on Spark.

A rule set is data (JSON / a list of :class:`Rule`); it compiles to Spark
SQL expressions, so evaluating any number of rules is one lazy, distributed
projection.  Views over the evaluated table (summaries, matrices,
rankings, drill-downs, exports) and the month-partitioned trend store are
ordinary DataFrame plans.
"""

from rulescope.functions.columns import norm, num, pct, pct_text, qcol
from rulescope.operators.rules import Evaluation, Rule, compile_condition, compile_rule, evaluate, validate_rules

__all__ = [
    "Evaluation",
    "Rule",
    "compile_condition",
    "compile_rule",
    "evaluate",
    "norm",
    "num",
    "pct",
    "pct_text",
    "qcol",
    "validate_rules",
]
