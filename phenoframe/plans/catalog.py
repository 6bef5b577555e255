"""All registered queries."""

from phenoframe.plans import axes, checks, contacts, geometry, imaging, ownership, plates, prepared, records, regions, tabular, tracking  # noqa: F401
from phenoframe.plans.registry import ORACLES, QUERIES  # noqa: F401
