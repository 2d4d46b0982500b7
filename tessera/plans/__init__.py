"""Planning: syntax trees to Spark SQL."""
