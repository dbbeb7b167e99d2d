"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; the driver entry point adds its
queries only when it can be imported.
"""
