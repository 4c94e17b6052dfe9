"""The streaming of larkspur."""
