"""Evidence engine on PySpark: pages to chunks to cited, verified evidence."""

__version__ = "0.1.0"
