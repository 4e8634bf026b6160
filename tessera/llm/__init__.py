"""Operators for preparing training data, each built by one named method.

Nothing else in the library imports this package; it borrows only general
helpers (``tessera.session``).  ``queries`` holds the driver bindings.
"""
