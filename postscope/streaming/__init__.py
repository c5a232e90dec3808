"""Counts over a growing folder of posts."""
