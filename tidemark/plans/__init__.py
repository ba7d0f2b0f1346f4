"""Operators composed over tables: the flagship plan and the registered queries."""
