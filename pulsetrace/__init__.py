"""Beaconing-traffic analytics on Spark: read logs, label, encode, fit, score, evaluate."""
