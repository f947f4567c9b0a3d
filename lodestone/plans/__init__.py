"""Search plans, query registry and command line."""
