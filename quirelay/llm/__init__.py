"""Training-data operators: one module each, plus ``queries`` with their registrations.

Nothing outside this subpackage imports it.
"""
