"""Every analysis as a registered query on the star-schema tables, next to its SQL check."""

from catalog import campaigns, churn, experiments, forecasting, ltv, metrics, segmentation  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
