"""Where tables come from."""

from graphloom.sources.tables import MODEL, load_model, read

__all__ = ["MODEL", "load_model", "read"]
