"""tessera: analytics over foreign-key graphs, written as Spark DataFrame plans."""

__version__ = "0.1.0"
