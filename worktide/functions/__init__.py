"""Column expressions; nothing here leaves the JVM."""
