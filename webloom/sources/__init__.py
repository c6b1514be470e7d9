"""Sources: driver tables, seed lists, host chunk files."""
