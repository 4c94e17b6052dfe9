"""The functions of larkspur."""
