"""The operators of larkspur."""
