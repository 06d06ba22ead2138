"""Mixed-type synthetic tables, and the statistics that judge them, as Spark DataFrame work."""

__version__ = "0.1.0"
