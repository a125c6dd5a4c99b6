"""Column helpers shared by the operators; every one stays inside the JVM."""
