"""Scalar functions: column expressions and the pure Python functions behind Arrow stages."""
