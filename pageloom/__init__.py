"""pageloom: a PySpark-native engine for analysing captured web sites."""

__version__ = "0.1.0"
