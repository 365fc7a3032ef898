"""PySpark jobs over pointer-interaction sequences."""
