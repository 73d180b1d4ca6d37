"""Jobs that run from a command line: python -m jobs.NAME --help."""
