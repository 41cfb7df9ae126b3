"""Operators of a training-data pipeline: each module holds one operator; nothing else in the package imports them."""
