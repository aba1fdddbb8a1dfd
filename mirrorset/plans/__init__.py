"""End-to-end stage plans built from the operators."""
