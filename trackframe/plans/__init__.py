"""All registered queries."""

from trackframe.plans.registry import ORACLES, QUERIES  # noqa: F401
from trackframe.plans import analysis, datasets, evaluation, geometry, matching, pixels, rules, sources, tracking, trajectory  # noqa: F401
