"""bandlens: explicit formulas, neighbourhood windows, metrics and search over tables, on PySpark."""

__version__ = "0.1.0"
