"""Batch operators on mutation logs, node and edge state, and registries."""
