"""Static tables of running streams: read once, and again at an interval.

A stream that joins a static table scans its source in every micro-batch, unless the table is kept. A kept
table is read by the first micro-batch that needs it, with its declared columns, and held by the executors in
memory or, beyond that, on their disks. A part that is lost with an executor is read again from the source.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from rtflow.sources.tables import TableSpec
from rtflow.table import FlowTable

#: How often, in seconds, a refresh that is due looks whether a micro-batch is running.
_PAUSE = 0.05


class StaticTables:
    """Keeps the static ones of ``tables``; every ``refresh`` seconds, if given, they are read anew.

    ``specs`` tell which tables are files, whose listing a refresh renews as well. A refresh waits until no
    micro-batch is running, for an interval at most, so all of a micro-batch joins one state of a table. If a
    source cannot be listed then, the tables stay as they are until the next refresh.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, FlowTable | DataFrame],
        specs: Iterable[TableSpec | Mapping] = (),
        refresh: float | None = None,
    ):
        if refresh is not None and refresh <= 0:
            raise ValueError("refresh must be a positive number of seconds")
        self._spark, self._every = spark, refresh
        known = {name: FlowTable.of(table) for name, table in tables.items()}
        self._kept = {name: table.df for name, table in known.items() if table.static}
        records = [s if isinstance(s, TableSpec) else TableSpec.from_dict(s) for s in specs]
        self._paths = {s.table_id: s.storages["files"]["path"] for s in records if s.storages.get("files")}
        self._end, self._thread = threading.Event(), None
        #: How often the tables have been read anew.
        self.refreshed = 0
        for df in self._kept.values():
            df.persist(StorageLevel.MEMORY_AND_DISK)
        if refresh is not None and self._kept:
            self._thread = threading.Thread(target=self._run, name="rtflow-static-tables", daemon=True)
            self._thread.start()

    def refresh(self) -> None:
        """Let the next micro-batch read the tables anew."""
        for name, df in self._kept.items():
            if name in self._paths:
                # Lists the files again and drops what has been kept of them; the table stays registered.
                self._spark.catalog.refreshByPath(self._paths[name])
            else:
                df.unpersist()
                df.persist(StorageLevel.MEMORY_AND_DISK)
        self.refreshed += 1

    def close(self) -> None:
        """Stop refreshing, and keep the tables no longer."""
        self._end.set()
        if self._thread is not None:
            self._thread.join()
        for df in self._kept.values():
            df.unpersist()

    def __enter__(self) -> "StaticTables":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _idle(self) -> bool:
        return not any(query.status["isTriggerActive"] for query in self._spark.streams.active)

    def _run(self) -> None:
        while not self._end.wait(self._every):
            waited = 0.0
            while not self._idle() and waited < self._every and not self._end.wait(_PAUSE):
                waited += _PAUSE
            if not self._end.is_set():
                try:
                    self.refresh()
                except PySparkException:
                    continue
