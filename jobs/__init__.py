"""Runnable jobs on top of the library.  Each has a function that takes a session, and a command line around it."""
