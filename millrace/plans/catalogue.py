"""The registered queries and the SQL each of them must agree with."""

from millrace.plans import analysis_queries, metric_queries, model_queries, table_queries, text_queries  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401
