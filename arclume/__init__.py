"""arclume: graph analytics and data processing expressed as PySpark plans."""

__version__ = "0.1.0"
