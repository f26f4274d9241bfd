"""Operators over the catalogue and over captured pages."""
