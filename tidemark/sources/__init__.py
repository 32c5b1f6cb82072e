"""Reading and writing of series."""
