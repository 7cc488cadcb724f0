"""Claim-verification analytics on Spark.

Every operator is a function from DataFrames to a DataFrame built from Spark
joins, windows, aggregates and higher-order functions; model outputs
(captions, embeddings, logits, answers) enter as columns.
"""

__version__ = "0.1.0"
