"""Spark jobs over time-stamped observations: tracks, events, evidence graphs, audits."""
