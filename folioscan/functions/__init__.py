"""Scalar functions: text analysis, topic paths and the compiler of advanced queries."""
