"""State of a watcher: a JSON file that names its process, and how long it has been idle."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE_FILE = "watcher.json"
#: Seconds after which a watcher is idle, and dormant.
IDLE_AFTER, DORMANT_AFTER = 300, 1800


@dataclass
class WatcherState:
    pid: int
    root: str
    start_time: int
    status: str = "idle"
    last_event_at: int = 0

    @staticmethod
    def new(root: str) -> WatcherState:
        now = int(time.time())
        return WatcherState(os.getpid(), root, now, "idle", now)

    def is_live(self) -> bool:
        """Whether the process and the root still exist."""
        try:
            os.kill(self.pid, 0)
        except OSError:
            return False
        return os.path.exists(self.root)

    def write(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        temp = os.path.join(folder, STATE_FILE + ".new")
        with open(temp, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
        os.replace(temp, os.path.join(folder, STATE_FILE))

    @staticmethod
    def read(folder: str) -> WatcherState | None:
        try:
            with open(os.path.join(folder, STATE_FILE), encoding="utf-8") as f:
                return WatcherState(**json.load(f))
        except (OSError, ValueError, TypeError):
            return None

    @staticmethod
    def remove(folder: str) -> None:
        try:
            os.remove(os.path.join(folder, STATE_FILE))
        except OSError:
            pass


def idle_state(seconds: float) -> str:
    return "active" if seconds < IDLE_AFTER else "idle" if seconds < DORMANT_AFTER else "dormant"


def idle_state_column(seconds: Column) -> Column:
    return F.when(seconds < IDLE_AFTER, "active").when(seconds < DORMANT_AFTER, "idle").otherwise("dormant")


class IdleTracker:
    """Seconds since the last query or change."""

    def __init__(self, now=time.monotonic):
        self.now = now
        self.last_query = self.last_change = now()

    def record_query(self) -> None:
        self.last_query = self.now()

    def record_change(self) -> None:
        self.last_change = self.now()

    def state(self) -> str:
        return idle_state(self.now() - max(self.last_query, self.last_change))
