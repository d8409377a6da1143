"""Plans that several operators share, and the registered queries."""
