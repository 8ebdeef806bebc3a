"""Spectral analysis of feature vectors and relational helpers around it, Spark first."""
