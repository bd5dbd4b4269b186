"""Column expressions: text, maths and dates. All JVM-side."""
