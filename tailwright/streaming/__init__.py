"""The first steps over files that keep arriving."""
