"""All registered queries. Importing the plan modules fills the registry."""

from tradeloom.plans import base_sql  # noqa: F401  (shared SQL first)
from tradeloom.plans import forecast_plans  # noqa: F401
from tradeloom.plans import view_plans  # noqa: F401
from tradeloom.plans import audit_plans, dealer_plans, model_plans, text_plans  # noqa: F401
from tradeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
