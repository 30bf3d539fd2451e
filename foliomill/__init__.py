"""foliomill: cleaning, segmenting, batching and checking long-form text on Spark."""

__version__ = "0.1.0"
