"""ledgerlens: token-transfer analytics as Spark DataFrame jobs.

All tokens of a registry are processed in one job: the registry is a small
DataFrame, tokens are a column, and every analysis is a pure function from
DataFrames to a DataFrame.
"""

__version__ = "0.1.0"
