"""Composed plans: the bootstrap computations and the batch jobs around them."""
