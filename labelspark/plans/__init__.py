"""Prompts, inference and whole evaluations composed from the operators."""
