"""Corpus-preparation operators; see the README for the list."""
