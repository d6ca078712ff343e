"""The jobs, composed from the operators."""
