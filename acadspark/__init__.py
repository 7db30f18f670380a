"""acadspark: Spark-native ingestion and timetable analytics for university records.

Every operator is a DataFrame -> DataFrame function built from Catalyst
expressions, joins, aggregations and windows; see README.md for the map.
"""

__version__ = "0.1.0"
