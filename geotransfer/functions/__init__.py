"""Scalar column functions (all JVM-side expressions)."""
