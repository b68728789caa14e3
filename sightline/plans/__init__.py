"""Registered queries; importing the package registers all of them."""

from . import capture, catalog, flow, parts  # noqa: F401
