"""Whole jobs put together from the operators: a copy run and the run history."""
