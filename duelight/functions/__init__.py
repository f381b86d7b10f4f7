"""Functions of the entity verification library."""
