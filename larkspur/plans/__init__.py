"""The plans of larkspur."""
