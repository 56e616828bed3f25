"""Mobile-element insertion analytics as composable Spark DataFrame jobs."""

__version__ = "0.1.0"
