"""Column expressions: paths, text, glob rules, languages. All JVM-side."""
