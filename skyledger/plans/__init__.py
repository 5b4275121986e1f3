"""End-to-end analyses assembled from the operators."""
