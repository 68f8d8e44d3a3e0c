"""Log lines as text or JSON, by the standard library's logging."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

TRACE = 5
LEVELS = {"trace": TRACE, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "off": logging.CRITICAL + 10}


class Lines(logging.Formatter):
    def __init__(self, as_json: bool = False):
        super().__init__()
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        level = {logging.WARNING: "warn", TRACE: "trace"}.get(record.levelno, record.levelname.lower())
        part = record.name.rpartition(".")[2]
        if self.as_json:
            return json.dumps({"ts": at, "level": level, "comp": part, "msg": record.getMessage()}, ensure_ascii=False)
        return f"{at}  {level:<5} {part}: {record.getMessage()}"


def configure(level: str = "info", as_json: bool = False) -> logging.Logger:
    """The library's logger, at a level by name."""
    if level not in LEVELS:
        raise ValueError(f"no log level: {level}")
    logger = logging.getLogger("flowlens")
    handler = logging.StreamHandler()
    handler.setFormatter(Lines(as_json))
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(LEVELS[level])
    return logger
