"""The query language and the engine that runs requests."""
