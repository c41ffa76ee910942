"""Derived relations and the registered queries."""
