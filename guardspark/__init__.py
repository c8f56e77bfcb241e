"""guardspark: screening of LLM traffic and training corpora as Spark jobs."""

__version__ = "0.1.0"
