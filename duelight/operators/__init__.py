"""Operators of the entity verification library."""
