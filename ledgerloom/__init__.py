"""Business-document analytics as DataFrame -> DataFrame jobs on Spark."""

__version__ = "0.1.0"
