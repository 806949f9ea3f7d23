"""Training-data operators: token rollups, scans, media, filters, joins, packing.

Nothing outside this subpackage imports it. Each module holds one operator with
its general interface; ``queries`` holds the thin registered queries.
"""
