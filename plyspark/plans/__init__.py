"""Registered queries and the corpus that they run on."""
