"""The sources of larkspur."""
