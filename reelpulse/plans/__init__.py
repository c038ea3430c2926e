"""Operator registry and the independent SQL formulations used as oracles."""
