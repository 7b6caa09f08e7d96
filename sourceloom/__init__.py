"""A Spark-native engine for analysing source code with embedded SQL, and the data around it."""

__version__ = "0.1.0"
