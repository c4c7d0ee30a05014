"""signfold: exact-match fingerprint retrieval and its evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
