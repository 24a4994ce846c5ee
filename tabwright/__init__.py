"""Tabular binary classification on Spark: clean, check, encode, split, fit,
score, evaluate and measure, for any table with named columns."""
