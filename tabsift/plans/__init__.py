"""Registered queries and the SQL that says the same."""

from tabsift.plans import checks, golden, more, screening, verbs  # noqa: F401
from tabsift.plans.registry import ORACLE, QUERIES  # noqa: F401
