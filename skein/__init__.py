"""Skein: graph and record analytics on PySpark DataFrames.

``operators`` hold the algorithms, ``sources`` the readers and writers,
``functions`` column expressions, ``plans`` composite reports and the query
catalogue, ``streaming`` the Structured Streaming forms.
"""

__version__ = "0.1.0"
