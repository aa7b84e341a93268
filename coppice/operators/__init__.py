"""DataFrame operators over source files and their syntax nodes."""
