"""All queries of the library proper."""

from waymark.plans import edits, geometry, lines, shapes, spatial, tracks, transit  # noqa: F401
from waymark.plans.registry import QUERIES, SQL  # noqa: F401
