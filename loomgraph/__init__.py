"""Typed dataflow graphs, run logs, overlays and graph validation as Spark jobs."""
