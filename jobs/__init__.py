"""Runnable jobs over the given tables, each with a command line, a config file and a function that takes a session."""
