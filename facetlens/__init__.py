"""facetlens: structure of short texts from their embedding vectors, on Spark."""
