"""quayline: Spark-native closed-loop decision analytics for supply events.

Every operator is a function ``DataFrame[, params] -> DataFrame`` built from
Spark SQL expressions, windows, joins and aggregates; nothing in a data path
collects rows to the driver.
"""

__version__ = "0.1.0"
