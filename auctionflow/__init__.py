"""Auction analytics on Spark: batch plans, their streaming twins, sources, and a query runner."""
