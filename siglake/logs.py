"""Logging of the package on the driver."""

from __future__ import annotations

import logging

FORMAT = "%(asctime)s | %(name)s | %(levelname)s | %(message)s"


def configure_logging(level: int | str = logging.INFO, fmt: str = FORMAT) -> None:
    """Sets the root logger up anew; it may be called again."""
    logging.basicConfig(level=level, format=fmt, force=True)


def get_logger(name: str = "siglake") -> logging.Logger:
    return logging.getLogger(name)
