"""Registered queries over the driver's tables."""

from . import fields, flow, matching, quality, vouchers  # noqa: F401
