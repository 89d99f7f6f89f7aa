"""Column -> Column functions. All run inside the JVM."""
