"""Sources of the entity verification library."""
