"""Aggregates, joins, series, sketches, rules and models over packet and snapshot tables."""
