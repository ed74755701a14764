"""Spark jobs over typed knowledge graphs: model tables, mappings, logs, versions, graph walks, triples."""
