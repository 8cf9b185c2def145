"""inkfold: a PySpark-native engine for building, cleaning and scoring training corpora."""

__version__ = "0.1.0"
