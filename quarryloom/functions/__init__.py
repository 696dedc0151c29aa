"""Column functions: pure expressions that Catalyst can optimise."""
