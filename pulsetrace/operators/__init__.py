"""Relational steps of the pipeline, as DataFrame in, DataFrame out."""
