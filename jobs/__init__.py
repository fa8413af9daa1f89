"""Runnable jobs over plain paths: python -m jobs.<name> --help."""
