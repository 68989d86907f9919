"""Scalar functions: columns in, column out, inside generated code wherever Spark's functions reach."""
