"""Quillspark streaming."""
