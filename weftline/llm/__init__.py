"""Training-data pipeline operators: quality, dedup, mixing, scoring, encoding.

Nothing outside this subpackage imports it. ``queries.py`` holds one thin query
per operator; the modules hold the operators with their own general interfaces.
"""
