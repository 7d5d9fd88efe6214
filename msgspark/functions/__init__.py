"""Column functions: every function takes and returns Columns and stays on the JVM."""
