"""terrazzo: keyed, spatial, ordered and graph operators as lazy PySpark DataFrame functions."""

__version__ = "0.1.0"
