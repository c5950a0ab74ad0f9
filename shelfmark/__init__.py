"""shelfmark: reconciling a local record collection with an external catalogue on Spark."""

__version__ = "0.1.0"
