"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries``
registers one digest query per operator.  Nothing outside this subpackage
imports it.
"""
