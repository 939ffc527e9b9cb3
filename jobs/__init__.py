"""Runnable jobs: each has a command line, a small JSON file of settings, and a function that takes a session."""
