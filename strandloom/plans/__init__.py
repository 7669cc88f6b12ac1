"""Stages: each a function from tables to a table, built from the operators."""
