"""Sprite images as tables: pixel operators, request and run data, and run streams on Spark."""
