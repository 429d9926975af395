"""conceptmill: typed concept graphs, learner evidence and retrieval as Spark DataFrame plans."""

__version__ = "0.1.0"
