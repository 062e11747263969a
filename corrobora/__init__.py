"""corrobora: claim-to-article evidence matching as Spark DataFrame jobs."""

__version__ = "0.1.0"
