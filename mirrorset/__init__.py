"""Counterfactual text augmentation as Spark DataFrame jobs."""
