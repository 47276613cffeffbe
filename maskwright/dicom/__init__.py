"""Metadata of medical images: attribute tables, profiles, actions, files."""
