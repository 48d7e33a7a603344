"""Whole jobs: build a labelled dataset; fit, score and evaluate a pipeline."""
