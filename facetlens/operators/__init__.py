"""Operators: DataFrame to DataFrame where relational, numpy kernels where dense."""
