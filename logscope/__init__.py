"""logscope: explain anomalies in large log collections with Spark DataFrames."""

__version__ = "0.1.0"
