"""Runnable jobs: each is a function that takes a session and paths, with a command line and a small configuration file."""
