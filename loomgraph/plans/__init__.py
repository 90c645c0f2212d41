"""Declarative specs: graph types, keyword lists, rules."""
