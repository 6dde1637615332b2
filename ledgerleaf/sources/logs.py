"""Logging of jobs: to the console and, where a file is named, to it too."""

from __future__ import annotations

import logging
import os

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def logger(name: str, file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The package's logger of that name with fresh handlers; what it says goes to them only."""
    log = logging.getLogger(f"ledgerleaf.{name}")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    log.setLevel(level)
    log.propagate = False
    return log
