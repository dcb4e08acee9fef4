"""Whole pipelines wired from the operators."""
