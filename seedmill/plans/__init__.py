"""Stages made of several operators."""
