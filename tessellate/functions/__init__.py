"""Function libraries: aggregates, dates, text, JSON, collections, full-text search, user functions."""
