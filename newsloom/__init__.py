"""News analytics as lazy DataFrame transforms."""

__version__ = "0.1.0"
