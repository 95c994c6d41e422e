"""tagwright: behaviour-tag discovery and evaluation for chat-assistant
responses, built on Spark DataFrames, Spark SQL and Spark ML."""

__version__ = "0.1.0"
