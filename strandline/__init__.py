"""Trajectory analytics on Spark: scans, parsers, facts, scores, selection and export of agent-exploration data."""
