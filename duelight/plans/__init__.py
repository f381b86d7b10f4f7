"""Plans of the entity verification library."""
