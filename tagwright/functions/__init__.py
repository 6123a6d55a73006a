"""Column -> Column functions; all run inside the JVM except the edit distance."""
