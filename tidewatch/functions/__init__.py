"""Column builders: pure functions ``Column -> Column`` on Spark built-ins."""
