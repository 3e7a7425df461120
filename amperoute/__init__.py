"""Fleet telemetry and charging analytics as composable Spark DataFrame operators."""
