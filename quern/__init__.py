"""quern: a schema-first analytics engine whose every query is one lazy Spark DataFrame plan."""
