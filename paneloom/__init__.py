"""Panel analytics on Spark: entities observed over periods, as DataFrame transformations."""

from paneloom.session import configure, scratch, shared_folder

__all__ = ["configure", "scratch", "shared_folder"]
