"""panelwright: panel and time-series analytics as plain Spark DataFrame operators."""
