"""Operators for preparing training data: one module each, plus the registered queries."""
