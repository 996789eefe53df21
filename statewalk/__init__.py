"""State-sequence analytics on PySpark: hidden semi-Markov models, decoded-sequence statistics,
resampling tests and state-network topology, expressed as Spark jobs."""

__version__ = "0.1.0"
