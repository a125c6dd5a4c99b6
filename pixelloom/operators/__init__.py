"""Relational operators over pixel, frame, request and run tables."""
