"""corpusloom: document retrieval and corpus analytics as Spark DataFrame plans."""

__version__ = "0.2.0"
