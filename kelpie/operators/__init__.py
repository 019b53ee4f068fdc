"""DataFrame operators on vector tables: scales, metrics, neighbours, alignment, layouts, matrices, packing."""
