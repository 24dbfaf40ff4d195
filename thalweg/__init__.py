"""Drainage analytics on Spark: flow graphs, basins, rivers, climate and search as DataFrame operators."""
