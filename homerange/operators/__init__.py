"""The operators of the analysis, DataFrame in and DataFrame out."""
