"""sentryflow: a PySpark-native engine for labelled flow and device-event data."""

__version__ = "0.1.0"
