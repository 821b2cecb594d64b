"""Column-level functions: basis expansions, metrics, residual statistics, own numerics."""
