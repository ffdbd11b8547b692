"""stratalog: event-sourced keyed tables as declarative Spark plans."""
