"""Quillspark sources."""
