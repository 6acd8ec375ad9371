"""Declarative batch and streaming data pipelines that run as Spark DataFrames."""
