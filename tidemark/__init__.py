"""tidemark: analytics over partitioned message logs, expressed as Spark DataFrame plans."""
