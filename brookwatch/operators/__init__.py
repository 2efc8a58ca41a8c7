"""DataFrame operators: aggregation, ranking, joins, rule matching."""
