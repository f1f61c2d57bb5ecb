"""harvestry — Spark-native crop-yield analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates, higher-order functions and Spark ML.
"""

__version__ = "0.1.0"
