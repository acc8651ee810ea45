"""Whole commands composed from operators, and the registered queries."""
