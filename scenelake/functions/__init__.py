"""Column functions: every function maps Columns to a Column and stays in the JVM."""
