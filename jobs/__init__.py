"""Jobs that run from the command line: python -m jobs.<name> --help."""
