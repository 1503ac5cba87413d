"""Code-corpus analytics as PySpark DataFrame operators."""
