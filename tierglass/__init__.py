"""Document sensitivity analytics as DataFrame -> DataFrame operators on Spark."""
