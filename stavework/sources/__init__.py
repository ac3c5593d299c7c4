"""Files that a corpus is read from and written to."""
