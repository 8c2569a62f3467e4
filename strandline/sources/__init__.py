"""Readers: shell histories, live events, catalogue pages, evaluation sets."""
