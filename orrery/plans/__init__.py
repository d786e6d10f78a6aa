"""Queries on the driver's tables, one or more for each operator; importing this package registers them."""

from . import cameras, files, grids, properties, relational, scalars, sections, spatial, statistics, streams  # noqa: F401
