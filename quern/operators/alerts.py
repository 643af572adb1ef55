"""Scheduled alert queries with callback and table sinks and a history."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

LEAST_SECONDS, MOST_ROWS = 10, 1000
_UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600}


@dataclass
class Alert:
    name: str
    query: str
    every: int
    webhook: str | None = None
    table: str | None = None
    enabled: bool = True
    busy: threading.Lock = field(default_factory=threading.Lock)


def parse(text: str) -> Alert:
    """CREATE ALERT a AS SELECT … EVERY n SECONDS|MINUTES|HOURS [WEBHOOK 'url'] [INSERT INTO t]."""
    m = re.match(r"\s*CREATE\s+ALERT\s+(\w+)\s+AS\s+(.*?)\s+EVERY\s+(\d+)\s+(SECOND|MINUTE|HOUR)S?(?:\s+WEBHOOK\s+'([^']*)')?(?:\s+INSERT\s+INTO\s+([\w./]+))?\s*;?\s*$", text, re.I | re.S)
    if not m:
        raise ValueError("not a CREATE ALERT statement")
    every = int(m[3]) * _UNITS[m[4].upper()]
    if every < LEAST_SECONDS:
        raise ValueError(f"alerts run every {LEAST_SECONDS} seconds at most")
    return Alert(m[1], m[2], every, m[5], m[6])


class Scheduler:
    """Runs alerts when they are due.  With history_table each run is a row of that table."""

    def __init__(self, spark: SparkSession, sql: Callable, notify: Callable[[Alert, list], None], history_table: str | None = None) -> None:
        self.spark, self.sql, self.notify, self.history_table = spark, sql, notify, history_table
        self.alerts: dict[str, Alert] = {}
        self.history: list[dict] = []
        self.stop = threading.Event()

    def create(self, text: str) -> Alert:
        alert = parse(text)
        self.alerts[alert.name] = alert
        return alert

    def drop(self, name: str) -> None:
        if name not in self.alerts:
            raise ValueError(f"no alert {name}")
        del self.alerts[name]

    def alter(self, name: str, change: str) -> None:
        """ENABLE, DISABLE, or [SET] EVERY n SECONDS|MINUTES|HOURS."""
        alert = self.alerts.get(name)
        if alert is None:
            raise ValueError(f"no alert {name}")
        if change.strip().upper() in ("ENABLE", "DISABLE"):
            alert.enabled = change.strip().upper() == "ENABLE"
        else:
            alert.every = parse(f"CREATE ALERT {name} AS SELECT 1 {re.sub(r'^\s*SET\s+', '', change, flags=re.I)}").every

    def fire(self, alert: Alert) -> bool:
        """Run once; skipped if the last run has not ended.  A report has at most MOST_ROWS rows.

        The query runs once: report and table get the same rows.  A run longer than the
        smaller of the interval and a minute is cancelled.
        """
        if not alert.enabled or not alert.busy.acquire(blocking=False):
            return False
        began, tag = time.time(), f"alert-{alert.name}"
        limit = threading.Timer(min(alert.every, 60), lambda: self.spark.interruptTag(tag))
        try:
            limit.start()
            self.spark.addTag(tag)
            df = self.sql(alert.query)
            rows = df.limit(MOST_ROWS).collect()
            if rows and alert.table:
                self.spark.createDataFrame(rows, df.schema).write.mode("append").saveAsTable(alert.table)
            if rows and alert.webhook:
                self.notify(alert, rows)
            self._note(alert, len(rows), began, None)
        except Exception as e:
            self._note(alert, 0, began, str(e))
            raise
        finally:
            limit.cancel()
            self.spark.removeTag(tag)
            alert.busy.release()
        return True

    def _note(self, alert: Alert, rows: int, began: float, error: str | None) -> None:
        self.history.append({"alert": alert.name, "rows": rows, "seconds": time.time() - began, "error": error})
        if self.history_table:
            row = [(alert.name, began, rows, time.time() - began, error)]
            self.spark.createDataFrame(row, "alert string, at double, rows int, seconds double, error string").coalesce(1).write.mode("append").saveAsTable(self.history_table)

    def run(self) -> None:
        due = {n: time.time() for n in self.alerts}
        while not self.stop.wait(1):
            for name, alert in list(self.alerts.items()):
                if time.time() >= due.get(name, 0):
                    due[name] = time.time() + alert.every
                    threading.Thread(target=self.fire, args=(alert,), daemon=True).start()
