"""kelpie: a tensor-analytics and corpus-processing engine on PySpark."""

__version__ = "0.1.0"
