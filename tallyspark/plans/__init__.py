"""Queries over the given tables; importing the package registers all of them."""

from tallyspark.plans import catalog, crawled, details, documents, files, grids, layouts, markup, offers, stitching, timed, values  # noqa: F401
