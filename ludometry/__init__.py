"""ludometry: live-ops and monetization analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns DataFrames. Column names,
thresholds and category lists are arguments with defaults for the canonical
``players`` / ``transactions`` / ``ab_units`` tables (``sources.schemas``).
"""

__version__ = "0.1.0"
