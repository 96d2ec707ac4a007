"""Static inspection of machine-learning artifacts as Spark queries."""

__version__ = "0.2.0"
