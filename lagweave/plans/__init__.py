"""Model specification, fit and predict over DataFrames, reports."""
