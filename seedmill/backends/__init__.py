"""Pluggable services: completions, judges, type checkers, import fixers, tokenizers and code execution."""
