"""Operators for preparing training corpora: scans, joins, models and media columns over document tables."""
