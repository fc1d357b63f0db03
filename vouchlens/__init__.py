"""Payment-audit analytics as composable PySpark DataFrame operators."""
