"""Earth-observation analytics as composable PySpark DataFrame operators."""
