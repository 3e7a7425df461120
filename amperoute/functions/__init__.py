"""Column -> Column building blocks; every function stays inside JVM code generation."""
