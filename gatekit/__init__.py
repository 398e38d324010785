"""gatekit: risk scoring, gating and audit of model decisions on Spark DataFrames."""

__version__ = "0.1.0"
