"""Column functions; all but the similarity score stay inside the JVM."""
