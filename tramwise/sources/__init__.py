"""Where the transit tables come from."""

from .tables import Tables

__all__ = ["Tables"]
