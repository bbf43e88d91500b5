"""Operators that prepare training text: mixing, deduplication, packing, language, privacy and token output.

Nothing else in the library imports this subpackage; removing it leaves the rest intact.
"""
