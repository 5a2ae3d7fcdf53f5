"""Column functions; everything here stays in the JVM unless its name says otherwise."""
