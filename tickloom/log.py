"""Logging of the engine: handlers on the package's own logger, set from the environment; the root logger is left alone."""

from __future__ import annotations

import logging
import os
import sys
from logging.handlers import TimedRotatingFileHandler

NAME = "tickloom"
FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"
#: libraries whose chatter below a warning is muted
MUTED = ("py4j", "pyspark", "urllib3")


def get_logger(name: str | None = None) -> logging.Logger:
    """The package's logger, or one below it."""
    return logging.getLogger(NAME if not name else name if name.split(".")[0] == NAME else f"{NAME}.{name}")


def setup_logging(console: str | None = None, file: str | None = None, path: str | None = None) -> logging.Logger:
    """Levels for the console and for a file that starts anew each midnight.

    They default to TICKLOOM_CONSOLE_LEVEL (WARNING), TICKLOOM_FILE_LEVEL (INFO) and
    TICKLOOM_LOG_FILE (none: no file). Calling it again replaces the handlers.
    """
    console = (console or os.environ.get("TICKLOOM_CONSOLE_LEVEL", "WARNING")).upper()
    file = (file or os.environ.get("TICKLOOM_FILE_LEVEL", "INFO")).upper()
    path = path or os.environ.get("TICKLOOM_LOG_FILE")
    known = logging.getLevelNamesMapping()
    if bad := [x for x in (console, file) if x not in known]:
        raise ValueError(f"unknown level {bad[0]}")
    log = get_logger()
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers = [(logging.StreamHandler(sys.stderr), console)]
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        handlers.append((TimedRotatingFileHandler(path, when="midnight", backupCount=7), file))
    for h, level in handlers:
        h.setLevel(level)
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    log.setLevel(min(known[level] for _, level in handlers))
    log.propagate = False
    for name in MUTED:
        logging.getLogger(name).setLevel(logging.WARNING)
    return log
