"""All registered queries."""

from quillworks.registry import (  # noqa: F401
    content_checks,
    counter_checks,
    engagement_checks,
    list_checks,
    scalar_checks,
    workflow_checks,
)
from quillworks.registry.checks import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
