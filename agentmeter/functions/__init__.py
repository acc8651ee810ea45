"""Scalar building blocks: column expressions evaluated inside the JVM."""
