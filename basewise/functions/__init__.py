"""Column functions. All but the adapter scan stay inside the JVM."""
