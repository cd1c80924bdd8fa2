"""Price-index analytics on PySpark: quotes in, a published index and its audits out."""

__version__ = "0.1.0"
