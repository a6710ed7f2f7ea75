"""Whole results made of operators, and the registered queries."""
