"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Every operator reads
only the columns it names, so further columns of any name may be present.
"""
