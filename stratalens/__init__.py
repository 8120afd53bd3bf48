"""Stratalens: PySpark-native analytics for software-engineering and corpus data."""
