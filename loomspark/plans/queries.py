"""All registered queries over the given tables, with their SQL."""

from loomspark.plans import concepts, documents, hierarchy, scoring  # noqa: F401
from loomspark.plans.registry import ORACLES, QUERIES  # noqa: F401
