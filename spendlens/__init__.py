"""spendlens: Spark-native bank-transaction analytics and classification."""

__version__ = "0.1.0"
