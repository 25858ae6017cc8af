"""What the driver keeps beside the data: locks on paths, a bounded set of cached
tables, and jobs that run side by side and can be cancelled."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import InterruptError, ParallelError


class PathLocks:
    """Shared and exclusive locks by path, for this driver's writers and readers."""

    def __init__(self) -> None:
        self._changed = threading.Condition()
        self._readers: dict[str, int] = {}
        self._writers: set[str] = set()

    @contextmanager
    def shared(self, path: str):
        with self._changed:
            self._changed.wait_for(lambda: path not in self._writers)
            self._readers[path] = self._readers.get(path, 0) + 1
        try:
            yield
        finally:
            with self._changed:
                self._readers[path] -= 1
                if not self._readers[path]:
                    del self._readers[path]
                self._changed.notify_all()

    @contextmanager
    def exclusive(self, path: str):
        with self._changed:
            self._changed.wait_for(lambda: path not in self._writers and path not in self._readers)
            self._writers.add(path)
        try:
            yield
        finally:
            with self._changed:
                self._writers.discard(path)
                self._changed.notify_all()


class Resident:
    """At most ``most`` cached tables; the one used longest ago is let go first."""

    def __init__(self, most: int = 8) -> None:
        self.most = most
        self._held: OrderedDict[str, DataFrame] = OrderedDict()

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name in self._held:
            self._held.move_to_end(name)
            return self._held[name]
        while len(self._held) >= self.most:
            self._held.popitem(last=False)[1].unpersist()
        self._held[name] = make().persist()
        return self._held[name]

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def clear(self) -> None:
        while self._held:
            self._held.popitem()[1].unpersist()


class Jobs:
    """Functions of the driver that start Spark jobs side by side, in one job group."""

    def __init__(self, spark: SparkSession, threads: int = 4, group: str = "tessera-jobs") -> None:
        self.spark, self.group = spark, group
        self._pool = ThreadPoolExecutor(threads)
        self._cancelled = False

    def add(self, job: Callable[[], object]) -> Future:
        out: Future = Future()

        def run() -> None:
            self.spark.sparkContext.setJobGroup(self.group, self.group, interruptOnCancel=True)
            try:
                out.set_result(job())
            except BaseException as e:  # noqa: BLE001  it is handed to the waiting side
                out.set_exception(InterruptError() if self._cancelled else e)

        def start() -> None:
            t = InheritableThread(target=run)
            t.start()
            t.join()

        self._pool.submit(start)
        return out

    def wait(self, futures: Iterable[Future]) -> list:
        try:
            return [f.result() for f in futures]
        except InterruptError:
            raise
        except Exception as e:
            raise ParallelError(str(e)) from e

    def cancel(self) -> None:
        self._cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def close(self) -> None:
        self._pool.shutdown()
