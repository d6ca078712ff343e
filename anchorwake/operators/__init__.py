"""DataFrame operators, from ordered sequences to player reports."""
