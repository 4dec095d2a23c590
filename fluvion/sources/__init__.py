"""Views of tables as panels, well files, and cutting of lineage."""
