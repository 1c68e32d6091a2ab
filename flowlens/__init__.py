"""flowlens: flow-feature engineering, leakage audit and evaluation on Spark."""

__version__ = "0.1.0"
