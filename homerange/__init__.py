"""homerange: local-market analysis of review data on Spark.

Every operator is DataFrame in, DataFrame out, and runs on the executors;
thresholds and literals of the original analysis are parameters.

Layout
------
``sources``    readers (NDJSON with nested records), stand-in tables derived
               from the driver's TPC-H-like tables, CSV/head extracts.
``functions``  column expressions (planar distance, case-insensitive
               substring match, safe column names, leading-number parse).
``operators``  the operators: geo, visits, clusters, ratings, categories,
               features, model, stats.
``plans``      the three end-to-end flows (who is local, what locals like,
               features + model) composed from the operators.
"""

from homerange.session import get_spark

__all__ = ["get_spark"]
