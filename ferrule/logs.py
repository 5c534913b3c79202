"""Logging: a file a day in a folder, and the standard error stream unless it is to be quiet."""

from __future__ import annotations

import logging
import os
from logging.handlers import TimedRotatingFileHandler

NAME, FORMAT = "ferrule", "%(asctime)s %(levelname)s %(message)s"


def init(folder: str, quiet: bool = False) -> logging.Logger:
    """The package's logger with fresh handlers; without a file where the folder can't be made."""
    log = logging.getLogger(NAME)
    log.setLevel(logging.INFO)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    handlers: list[logging.Handler] = [] if quiet else [logging.StreamHandler()]
    try:
        os.makedirs(folder, exist_ok=True)
        handlers.append(TimedRotatingFileHandler(os.path.join(folder, "log"), when="midnight", encoding="utf-8", utc=True))
    except OSError:
        pass
    for handler in handlers:
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)
    log.propagate = False
    return log
