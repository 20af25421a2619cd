"""Analyses of results, and the catalogue of registered queries."""
