"""Scalar functions: plain Python cores with vectorised wrappers, and Column builders."""
