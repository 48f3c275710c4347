"""All registered queries."""

from auditloom.plans import q_audits, q_budget, q_reports, q_responses, q_screen  # noqa: F401
from auditloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
