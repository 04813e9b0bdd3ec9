"""Registered queries; importing the package registers all of them."""

from docquarry.plans import answering, asking, indexing, ingesting, queries, records  # noqa: F401
