"""Sources: what a file is, containers and their members, word tables of recognised pages, metadata."""
