"""Filters, joins, aggregates, ranking, similarity, clustering, scoring and risk."""
