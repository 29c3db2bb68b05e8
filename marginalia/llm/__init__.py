"""Operators for training data: neighbours, splitting, tokenizing, leakage, personal information.

Nothing outside this subpackage imports it.
"""
