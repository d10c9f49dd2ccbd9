"""Stream and batch analytics for keyed event records, written on the Spark DataFrame API."""
