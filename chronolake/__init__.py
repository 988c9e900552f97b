"""chronolake: system-versioned tables and temporal analytics on PySpark."""
