"""Dataflow graphs: description, order, and compilation to one DataFrame lineage."""
