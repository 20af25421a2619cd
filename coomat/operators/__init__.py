"""Matrices, products, partitions and PageRank."""
