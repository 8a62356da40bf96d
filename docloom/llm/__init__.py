"""Training-data operators: mixing, dedup, scanning, sharding, formatting, scoring.

Nothing outside this subpackage imports it.
"""
