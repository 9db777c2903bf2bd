"""Multi-step plans built from the operators."""
