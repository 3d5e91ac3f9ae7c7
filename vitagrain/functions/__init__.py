"""Column functions: no UDFs, everything stays inside the JVM."""
