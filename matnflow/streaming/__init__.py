"""Checking a feed of posts as it grows."""
