"""Named steps over many services as one batch: a failure costs the pages that cause it, and every step leaves a record.

A step is a function from pages to findings and runs as one job over all services. If it fails, its pages are dealt into PARTS
folders by a hash of their key, and each part runs alone. The pages of all parts that fail are dealt together again, each part into SPREAD
by more of the hash, until a failing part holds one page: different keys have different hashes, so that comes to an end without a limit. That page gets an error row and all others keep their findings, however many fail. Without failures
nothing is dealt; with some, the pages are written once, then those of failing parts once for each level. So the jobs follow the failing pages and not the table.
A step that has no plan, as for want of a column, fails on no page of its own: it is not dealt, and each page gets its error row.

Findings go to ``<folder>/findings``, error rows to ``<folder>/errors``, and one row for each step to ``<folder>/steps``. What a step
wrote is counted while it is written (an observed metric), not by reading it again.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PARTS, SPREAD, AT_ONCE = 64, 4, 16
#: So many failing parts are dealt together at most; the others wait for their turn, so the driver holds a round's parts and not the table's.
MOST_ALONE = 1000
COLUMNS = ["page_id", "service", "url", "type", "title", "severity", "value"]
ERRORS = "step string, page_id long, service string, condition string, error string"
STEPS = "number int, step string, pages long, findings long, failed_pages long, seconds double, timed_out boolean, error string"


class Step(NamedTuple):
    name: str
    run: Callable[[DataFrame], DataFrame]


class Batch(NamedTuple):
    """Tables of a batch: findings (step and COLUMNS), errors (ERRORS) and steps (STEPS)."""

    findings: DataFrame
    errors: DataFrame
    steps: DataFrame


class TimedOut(Exception):
    pass


def condition_of(error: BaseException) -> str:
    """The error condition that Spark names, else the exception's own name."""
    named = re.search(r"\[([A-Z][A-Z0-9_.]{3,})\]", str(error))
    return named[1] if named else type(error).__name__


def text_of(error: BaseException) -> str:
    """One line about an error, without the stack."""
    lines = [x for x in str(error).splitlines() if "[" in x] or str(error).splitlines() or [""]
    return lines[0].strip()[:300]


def _found(step: Step, pages: DataFrame) -> DataFrame:
    return step.run(pages).select(F.lit(step.name).alias("step"), *COLUMNS)


def _without_plan(step: Step, pages: DataFrame) -> str | None:
    """The error of planning a step over no pages, whose cause can't be a page."""
    try:
        _found(step, pages.sparkSession.createDataFrame([], pages.schema))
    except AnalysisException as e:
        return text_of(e)
    except Exception:  # noqa: S110 - it may read its pages at once and want some
        pass
    return None


def _write(step: Step, pages: DataFrame, path: str, until: float | None) -> int:
    """Run a step over pages and write its findings; their number."""
    spark, counted, tag = pages.sparkSession, Observation(), f"step-{uuid.uuid4().hex}"
    late, timer = threading.Event(), None
    if until is not None:
        if until <= time.monotonic():
            raise TimedOut

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(until - time.monotonic(), stop)
        timer.start()
    spark.sparkContext.addJobTag(tag)
    try:
        found = _found(step, pages).observe(counted, F.count(F.lit(1)).alias("n"))
        found.write.mode("overwrite").parquet(path)
        return counted.get["n"]
    except Exception as e:
        if late.is_set():
            raise TimedOut from e
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)
        if timer:
            timer.cancel()


def _remove(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


class _Failures:
    """A step's error rows so far, which Spark writes; in the driver is only their number and the first condition."""

    def __init__(self, step: Step, folder: str):
        self.step, self.folder = step, folder
        self.n, self.first = 0, None

    def add(self, dealt: DataFrame, errors: dict[int, tuple[str, str]]) -> None:
        """Error rows for the pages of these parts of dealt, by the condition and text of each part's error."""
        spark, path, counted = dealt.sparkSession, f"{self.folder}/errors/{uuid.uuid4().hex}", Observation()
        why = spark.createDataFrame([(p, *e) for p, e in errors.items()], "__part long, condition string, error string")
        pages = dealt.filter(F.col("__part").isin(list(errors)))
        told = pages.join(F.broadcast(why), "__part").select(F.lit(self.step.name).alias("step"), "page_id", "service", "condition", "error")
        told.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.n, self.first = self.n + counted.get["n"], self.first or next(iter(errors.values()))[0]


def _isolated(failures: _Failures, pages: DataFrame, scratch: str, until: float | None) -> int:
    """The number of findings of pages on which the step has failed, whose error rows go to failures."""
    at_once = min(AT_ONCE, pages.sparkSession.sparkContext.defaultParallelism)  # more than cores are no faster and cost the driver memory
    with ThreadPoolExecutor(at_once) as pool:
        return _dealt(failures, pages, scratch, until, pool, PARTS, None)


def _dealt(failures: _Failures, pages: DataFrame, scratch: str, until: float | None, pool: ThreadPoolExecutor, parts: int, before: str | None) -> int:
    """A level of _isolated and what follows from it. before, where the pages lie, is removed when they are dealt.

    A part is a remainder of the key's hash by parts (of all pages; pages holds some of them), at last the hash. XXH64 maps longs one to one.
    """
    spark, step, schema = pages.sparkSession, failures.step, pages.schema
    path = f"{scratch}/{uuid.uuid4().hex}"
    key = F.xxhash64("page_id")
    pages.withColumn("__part", F.pmod(key, F.lit(parts)) if parts < 1 << 63 else key).repartition("__part").write.partitionBy("__part").parquet(path)
    if before is not None:
        _remove(spark, before)
    dealt = spark.read.schema(StructType([*schema.fields, StructField("__part", LongType())])).parquet(path)
    sizes = {r["__part"]: r["keys"] for r in dealt.groupBy("__part").agg(F.count_distinct(key).alias("keys")).collect()}

    def one(part: int) -> tuple[int, int, tuple[str, str] | None]:
        name = f"{failures.folder}/findings/{uuid.uuid4().hex}"
        try:
            return part, _write(step, spark.read.schema(schema).parquet(f"{path}/__part={part}"), name, until), None
        except TimedOut:
            raise
        except Exception as e:
            _remove(spark, name)
            return part, 0, (condition_of(e), text_of(e))  # the exception itself would hold on to the part's plan

    done = list(pool.map(one, sorted(sizes)))
    found = sum(n for _, n, _ in done)
    failed = {p: e for p, _, e in done if e is not None}
    errors = {p: e for p, e in failed.items() if sizes[p] == 1}
    if errors:
        failures.add(dealt, errors)
    rest = sorted(failed.keys() - errors.keys())
    if not rest:
        _remove(spark, path)
    for at in range(0, len(rest), MOST_ALONE):
        some, last = rest[at : at + MOST_ALONE], at + MOST_ALONE >= len(rest)
        own = dealt.filter(F.col("__part").isin(some)).drop("__part")
        found += _dealt(failures, own, scratch, until, pool, SPREAD * parts, path if last else None)
    return found


def run_steps(pages: DataFrame, steps: list[Step], folder: str, continue_on_error: bool = True, seconds: float | None = None) -> Batch:
    """Run steps in order over pages (page_id, service, url and what the steps read) and return what they wrote into a new folder.

    Without continue_on_error a service that failed takes no part in later steps. seconds is the time for all steps: what runs
    when it is over is cancelled and recorded as timed out, and later steps don't run. A step that fails on every page as it runs has each
    of them tried alone, so it takes a job a page at least: give seconds where that is too long.
    """
    spark = pages.sparkSession
    until = None if seconds is None else time.monotonic() + seconds
    records: list[tuple] = []
    spark.createDataFrame([], "step string, page_id long, service string, url string, type string, title string, severity int, value string").write.parquet(f"{folder}/findings/none")
    spark.createDataFrame([], ERRORS).write.parquet(f"{folder}/errors/none")
    for number, step in enumerate(steps, 1):
        began, mine, failures, n, late = time.monotonic(), pages, _Failures(step, folder), 0, False
        if not continue_on_error and any(r[4] for r in records):
            mine = pages.join(_below(spark, f"{folder}/errors").select("service").distinct(), "service", "left_anti")
        try:
            path = f"{folder}/findings/{uuid.uuid4().hex}"
            try:
                n = _write(step, mine, path, until)
            except TimedOut:
                raise
            except Exception as e:
                _remove(spark, path)
                if isinstance(e, AnalysisException) and _without_plan(step, mine) == text_of(e):
                    failures.add(mine.withColumn("__part", F.lit(0)), {0: (condition_of(e), text_of(e))})
                else:
                    n = _isolated(failures, mine, f"{folder}/scratch", until)
        except TimedOut:
            late = True
        told = "timed out" if late else f"{failures.first}: {failures.n} pages" if failures.n else None
        records.append((number, step.name, mine.select("page_id").count(), n, failures.n, time.monotonic() - began, late, told))
        if late:
            break
    spark.createDataFrame(records, STEPS).coalesce(1).write.parquet(f"{folder}/steps")
    return load(spark, folder)


def _below(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def load(spark: SparkSession, folder: str) -> Batch:
    return Batch(_below(spark, f"{folder}/findings"), _below(spark, f"{folder}/errors"), spark.read.parquet(f"{folder}/steps"))


def by_service(pages: DataFrame, batch: Batch) -> DataFrame:
    """(service, step, findings, failed_pages, condition): what each step did for each service; of several conditions the first by name."""
    services = pages.select("service").distinct()
    each = services.join(F.broadcast(batch.steps.filter("NOT timed_out").select("step")))  # a row for each step
    found = batch.findings.groupBy("service", "step").agg(F.count("*").alias("findings"))
    failed = batch.errors.groupBy("service", "step").agg(F.count("*").alias("failed_pages"), F.min("condition").alias("condition"))
    out = each.join(found, ["service", "step"], "left").join(failed, ["service", "step"], "left")
    return out.select("service", "step", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("failed_pages", F.lit(0)).alias("failed_pages"), "condition")
