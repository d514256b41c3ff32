"""Operators for training data: one module each, registered in ``registry``."""
