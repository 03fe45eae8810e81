"""Operators for preparing training data: sharding, search, clean-up, encoding and packing.

Nothing outside this folder imports it, so the folder can be taken away whole.
"""
