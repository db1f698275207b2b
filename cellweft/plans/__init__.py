"""End-to-end chains of operators, and the command line."""
