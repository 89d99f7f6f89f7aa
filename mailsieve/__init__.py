"""Spark-native e-mail threat analytics: DataFrame operators, ML branches and streaming jobs."""

__version__ = "0.1.0"
