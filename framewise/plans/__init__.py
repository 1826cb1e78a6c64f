"""End-to-end queries composed of operators."""
