"""Queries, expressions, models and windows: what declares a logical plan."""
