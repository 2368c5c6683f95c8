"""End-to-end flows composed from the operators."""

from homerange.plans.local_market import LocalMarket, Params

__all__ = ["LocalMarket", "Params"]
