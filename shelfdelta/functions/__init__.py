"""Column builders: everything here returns a ``Column`` and stays JVM-side."""
