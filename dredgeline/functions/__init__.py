"""Column builders used by several operators."""
