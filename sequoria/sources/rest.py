"""JSON services as tables: a paged index as a data source, look-ups with retries and one global rate, a cache between."""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sequoria.functions.plan import importable


class Limiter:
    """At most so many calls a second within a process, whatever the number of threads."""

    def __init__(self, per_second: float):
        self.gap, self.lock, self.free_at = 1.0 / max(per_second, 0.1), threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            time.sleep(max(0.0, self.free_at - time.monotonic()))
            self.free_at = time.monotonic() + self.gap


class Slots:
    """One rate over many tasks: call k of task p of n may start at begin + (k * n + p) / rate. Slots that went by unused
    are lost, so that all tasks together never exceed the rate."""

    def __init__(self, per_second: float, task: int, tasks: int, begin: float):
        self.gap, self.task, self.tasks, self.begin, self.k = 1.0 / per_second, task, tasks, begin, 0

    def wait(self) -> None:
        step = self.gap * self.tasks
        self.k = max(self.k, math.ceil((time.time() - self.begin - self.gap * self.task) / step))
        time.sleep(max(0.0, self.begin + self.gap * self.task + self.k * step - time.time()))
        self.k += 1


class Client:
    """GET of JSON with retries. The wait after try k is `pause` times k (linear) or 2 to the k (doubling)."""

    def __init__(self, root: str, tries: int = 3, pause: float = 1.0, doubling: bool = False, rest: float = 0.0, limiter: Limiter | Slots | None = None, timeout: float = 30.0):
        self.root, self.tries, self.pause, self.doubling, self.rest, self.limiter, self.timeout = root.rstrip("/"), max(1, tries), pause, doubling, rest, limiter, timeout

    def get(self, path: str, params: dict | None = None) -> object:
        url = self.root + path + (f"?{urlencode(params)}" if params else "")
        for k in range(1, self.tries + 1):
            try:
                if self.limiter:
                    self.limiter.wait()
                with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=self.timeout) as answer:
                    got = json.load(answer)
                time.sleep(self.rest)
                return got
            except (OSError, ValueError):  # network, HTTP and JSON failures alike
                if k == self.tries:
                    raise
                time.sleep(self.pause * (2 ** (k - 1) if self.doubling else k))
        raise AssertionError


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options.get("path_in_service", "/peptides"), int(options.get("pagesize", options.get("page_size", 1000)))
        if not 1 <= self.size <= 1000:
            raise ValueError("page_size must be between 1 and 1000")
        self.root, self.tries, self.pause = options["url"], int(options.get("tries", 3)), float(options.get("pause", 1.0))

    def _page(self, offset: int, size: int) -> dict:
        got = Client(self.root, self.tries, self.pause).get(self.path, {"limit": size, "offset": offset})
        if not isinstance(got, dict) or "data" not in got:
            raise ValueError("unexpected index response")
        return got

    def partitions(self) -> list[Page]:
        total = int(self._page(0, 1).get("totalCount", 0))
        return [Page(at) for at in range(0, total, self.size)] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for k, item in enumerate(self._page(partition.offset, self.size).get("data") or []):
            yield partition.offset + k, json.dumps(item, ensure_ascii=False)


class PagedJson(DataSource):
    """Format `paged_json`: an index with limit, offset and totalCount, one partition a page. Options: url,
    path_in_service, page_size (1 to 1000), tries, pause. Columns: ord, item (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "ord long, item string"

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(self.options)


def paged(spark: SparkSession, url: str, path: str = "/peptides", page_size: int = 1000, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """The items of a paged index as JSON text."""
    importable(spark)
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(url=url, path_in_service=path, page_size=page_size, tries=tries, pause=pause).load()


def cache_key(text) -> F.Column:  # noqa: ANN001
    return F.substring(F.sha2(text, 256), 1, 20)


Fetch = Callable[[str], object]


def from_service(url: str, form: str, limiter: Limiter | Slots, tries: int = 4, pause: float = 0.5) -> Fetch:
    """Looks a text up at `form` (with {} for the quoted text); each try waits for the limiter, and double after failures."""
    client = Client(url, tries, pause, doubling=True, limiter=limiter)
    return lambda text: client.get(form.format(quote(text, safe="")))


ANSWER = "request string, payload string, error string"


def looked_up(requests: DataFrame, cache: str, make_fetch: Callable[[Slots], Fetch], per_second: float = 2.5, tasks: int = 4) -> DataFrame:
    """(request, payload, error) for each distinct request (a column of text); payload is JSON text.

    What the cache folder has is reused; only the rest is fetched, by `tasks` tasks that share the rate by time slots.
    They write their answers to a folder of the run within the cache; nothing passes the driver. Failures are rows with
    an error and are not reused: the next run tries them again, and a run that was cut off resumes at what is missing.
    """
    spark = requests.sparkSession
    importable(spark)
    wanted = requests.select("request").filter("request is not null").distinct()
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    read = lambda: spark.read.schema(ANSWER).option("recursiveFileLookup", True).parquet(cache)
    good = lambda answers: answers.filter("error is null").groupBy("request").agg(F.max("payload").alias("payload"))
    misses = wanted.join(good(read()), "request", "left_anti") if there else wanted
    begin = time.time()

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make_fetch(Slots(per_second, TaskContext.get().partitionId() % tasks, tasks, begin))
        for frame in frames:
            rows = []
            for text in frame["request"]:
                try:
                    rows.append((text, json.dumps(one(text), ensure_ascii=False), None))
                except (OSError, ValueError, RuntimeError) as e:
                    rows.append((text, None, f"request_error:{type(e).__name__}:{e}"))
            yield pd.DataFrame(rows, columns=["request", "payload", "error"])

    run = f"{cache.rstrip('/')}/run-{uuid.uuid4().hex}"
    misses.repartition(tasks).mapInPandas(fetch, ANSWER).write.parquet(run)
    failed = spark.read.schema(ANSWER).parquet(run).filter("error is not null").select("request", "error")
    return wanted.join(good(read()), "request", "left").join(failed, "request", "left").select("request", "payload", "error")
