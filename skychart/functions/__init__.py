"""Column functions: no shuffle, evaluated inside the JVM."""
