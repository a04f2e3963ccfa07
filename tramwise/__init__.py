"""Transit analytics on Spark: route, delay, service, capacity and ridership."""

from .plans.reports import Transit
from .session import configure
from .sources import Tables

__all__ = ["Tables", "Transit", "configure"]
