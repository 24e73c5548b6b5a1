"""Scalar column functions, JVM-side."""
