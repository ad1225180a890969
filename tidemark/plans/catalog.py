"""All registered queries."""

from tidemark.plans import mining, ranking, scoring, streams  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
