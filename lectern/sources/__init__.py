from lectern.sources.catalog import LmsTables

__all__ = ["LmsTables"]
