"""Operators for preparing training text at scale.

Nothing else in ``lumenframe`` imports this subpackage; deleting it leaves the
image engine intact.
"""
