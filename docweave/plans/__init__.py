"""Whole pipelines put together from functions and operators."""
