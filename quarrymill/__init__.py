"""quarrymill: document, event-log and ticket analytics as pure PySpark DataFrame transformations."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
