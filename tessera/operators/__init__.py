"""Matrix and vector operators (element-wise, joins, aggregates, layout, ranking, sinks)."""
