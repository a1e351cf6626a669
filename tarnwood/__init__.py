"""Tarnwood: data preparation, profiling, text analytics and classic learning as PySpark DataFrame operators."""
