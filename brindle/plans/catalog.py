"""Every query of the core engine, by name, and the SQL that it must agree with."""

from brindle.plans import q_embedding, q_extract, q_metrics, q_rollout, q_text  # noqa: F401
from brindle.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
