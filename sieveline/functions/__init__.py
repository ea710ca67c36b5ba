"""Numpy kernels on small matrices, and scalar Column functions."""
