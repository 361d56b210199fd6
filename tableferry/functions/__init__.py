"""Column expressions for value rules, target shapes and failure codes (all JVM-side)."""
