"""tessera: a Spark-first engine for resolving records about people from many sources."""
