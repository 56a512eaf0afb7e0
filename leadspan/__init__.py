"""leadspan: outbound-sales analytics expressed as Spark DataFrame jobs."""
