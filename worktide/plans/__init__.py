"""Jobs composed of operators, one module per domain."""
