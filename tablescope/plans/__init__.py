"""Composed flows: prepare, workflows, explore."""
