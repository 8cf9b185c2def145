"""A source of answers: requests to a service, with retries; and rendering once for equal drawings."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold import store


def with_retries(ask: Callable[[str], str], tries: int = 3, base: float = 0.5, cap: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``ask`` tried again after a growing, jittered pause; the last error is raised."""

    def run(request: str) -> str:
        for k in range(tries):
            try:
                return ask(request)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(min(cap, base * 2**k) * (0.5 + random.random() / 2))
        raise AssertionError

    return run


def answered(requests: DataFrame, key: str, request: str, ask: Callable[[str], str], concurrency: int = 8) -> DataFrame:
    """``(key, predict, latency_sec)`` of the requests that were answered.

    Failed ones give no row, so that a later run asks them again; ``ask`` is called from ``concurrency`` threads a task.
    """
    kind = dict(requests.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> tuple[str | None, float]:
            begin = time.monotonic()
            try:
                return ask(text), time.monotonic() - begin
            except Exception:
                return None, 0.0

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf[request]))
                out = pd.DataFrame({key: pdf[key], "predict": [a for a, _ in got], "latency_sec": [s for _, s in got]})
                yield out[out.predict.notna()]

    return requests.select(key, request).mapInPandas(run, f"`{key}` {kind}, predict string, latency_sec double")


def rendered_once(rows: DataFrame, svg: str, render: Callable[[str], bytes], blank: bytes = b"") -> DataFrame:
    """Rows with ``image``: equal drawings are rendered once and joined back; a drawing that fails gives the blank image.

    Null drawings give a null image.
    """

    @F.pandas_udf("binary")
    def draw(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            try:
                return render(text)
            except Exception:
                return blank

        return texts.map(one)

    once = rows.filter(F.col(svg).isNotNull()).select(F.sha2(svg, 256).alias("_h"), F.col(svg).alias("_svg")).dropDuplicates(["_h"])
    images = once.select("_h", draw("_svg").alias("image"))
    return rows.withColumn("_s", F.sha2(svg, 256)).join(images, F.col("_s") == F.col("_h"), "left").drop("_s", "_h")


def side_by_side(rows: DataFrame, svg: str, order: str, n: int) -> DataFrame:
    """One row: the first ``n`` drawings, by ``order``, as one text."""
    first = rows.orderBy(order).limit(n)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, svg))), lambda x: x[svg]), "\n").alias("svg"))


def write_each(rows: DataFrame, key: str, content: str, folder: str, suffix: str) -> DataFrame:
    """A file a row, named by its key, in a folder that all machines share, given as a path or a URI of any file system that Arrow knows.

    Gives ``(key, error)`` of the rows that couldn't be written: null contents, names that aren't file names, and what the file system says.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            failed = []
            for name, data in zip(pdf[key], pdf[content], strict=True):
                try:
                    if data is None or name is None or "/" in str(name):
                        raise ValueError("no content" if data is None else "no file name")
                    with files.open_output_stream(f"{root}/{name}{suffix}") as out:
                        out.write(data.encode() if isinstance(data, str) else data)
                except (OSError, ValueError) as error:
                    failed.append((name, str(error)))
            yield pd.DataFrame(failed, columns=[key, "error"])

    return store.written(rows.select(key, content).mapInPandas(run, f"`{key}` {kind}, error string"), "failures")
