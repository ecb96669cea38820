"""Credit-portfolio and collections analytics as lazy PySpark DataFrame operators."""

__version__ = "0.1.0"
