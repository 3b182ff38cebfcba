"""geocairn: outdoor-activity and map-feature analytics as Spark DataFrame operators."""
