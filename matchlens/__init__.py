"""Matchup analytics on PySpark: recency-weighted statistics, look-back windows, ranks, consensus odds and back-tests."""
