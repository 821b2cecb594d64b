"""Lag projection, Gram aggregation, structure selection, estimation, prediction."""
