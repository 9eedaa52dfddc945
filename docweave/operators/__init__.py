"""DataFrame operators: anything that groups, joins, ranks or trains."""
