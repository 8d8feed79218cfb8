"""The query catalogue: operators bound to views of the tables, with their SQL."""
