"""Compositions of operators: recommendation plans and the checked query catalog."""
