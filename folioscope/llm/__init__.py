"""Operators for preparing training text; nothing else in folioscope imports this package."""
