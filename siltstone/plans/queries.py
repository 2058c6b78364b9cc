"""Queries over the driver's tables, and the SQL that says the same."""

from siltstone.plans import claims_plan, data_plan

QUERIES: dict = claims_plan.Q | data_plan.Q
ORACLES: dict = claims_plan.O | data_plan.O
