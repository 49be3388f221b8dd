"""Operators of a training-data pipeline over whole texts.

Each module holds one operator with its own general interface; ``queries``
derives the registered ``opN_*`` results from them. Nothing else in the
library imports this subpackage.
"""
