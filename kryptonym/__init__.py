"""Reversible de-identification of business text on Spark."""
