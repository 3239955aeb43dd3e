"""Reading and writing of paged texts."""
