"""Sources: text folders, delimited files, and a model server."""
