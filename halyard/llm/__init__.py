"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; the driver entry point adds its
queries when the subpackage is present.
"""
