"""Column-expression helpers (JVM-side, code-generated) and small per-row helpers."""
