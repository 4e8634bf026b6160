"""Column roles: which driver column plays which business part.

The measures are written against roles, not against table names, so the same
functions serve any marketplace-like schema.  ``DEFAULT`` binds them to the
TPC-H-like driver tables (order status F = delivered, P = canceled, state =
nation of the customer, delivery date = last ship date of the order, late =
more than ``promised_days`` after the order date).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    delivered_status: str = "F"
    canceled_status: str = "P"
    promised_days: int = 30
    # Money is summed exactly, in integer units: prices and discounts are
    # taken as decimals of so many places.  The driver tables have two; the
    # defaults leave room, and data with more places need larger numbers.
    price_decimals: int = 4
    discount_decimals: int = 4

    @property
    def money_scale(self) -> int:
        """Units per 1 of money."""
        return 10 ** (self.price_decimals + self.discount_decimals)


DEFAULT = Roles()
