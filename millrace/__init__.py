"""millrace: a raw-first data-quality engine expressed as Spark column expressions."""

__version__ = "0.1.0"
