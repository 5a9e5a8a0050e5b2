"""tidespan: event-aligned time-series analytics over many entities, expressed as Spark DataFrame plans."""
