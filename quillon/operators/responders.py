"""Running questions through responders, with resume (SRC-15, SNK-8, JN-13, CON-1, SCR-17, SCR-18)."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import answers as A
from quillon.plans.lineage import settle
from quillon.plans.skew import running


class Responder(Protocol):
    """Answers a prompt; raises PermanentError if no later try can succeed."""

    def __call__(self, model: str, prompt: str) -> str: ...


class PermanentError(RuntimeError):
    pass


def offline(model: str, prompt: str) -> str:
    """A deterministic stand-in for a model: its answer depends on the model and the prompt alone."""
    h = hashlib.md5(f"{model}\x00{prompt}".encode()).digest()
    return f"ANSWER: {'TRUE' if h[0] % 2 else 'FALSE'}\nCONFIDENCE: {h[1] / 255:.2f}\nREASONING_STEPS: {1 + h[2] % 10}"


def patient(ask: Responder, tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Responder:
    """Up to ``tries`` attempts with linear waits; a permanent error ends at once; failures become an error text."""

    def run(model: str, prompt: str) -> str:
        for k in range(1, tries + 1):
            try:
                return ask(model, prompt)
            except PermanentError as e:
                return f"[ERROR] {e}"
            except Exception as e:  # noqa: BLE001  a responder may fail in any way
                if k == tries:
                    return f"[ERROR] {e}"
                sleep(wait * k)
        return "[ERROR]"

    return run


def model_spec(text: str) -> tuple[str, str, str]:
    """``provider:model`` as provider, model and a name for columns; no provider means openai."""
    provider, _, model = text.rpartition(":")
    return provider or "openai", model, text.replace(":", "_").replace("/", "_")


# Providers and the names by which their models are known without one.
PROVIDERS = {"openai": ("gpt", "o1", "o3"), "anthropic": ("claude",), "google": ("gemini",), "meta": ("llama",), "deepseek": ("deepseek",)}


def model_metadata(spark, models: list[str]) -> DataFrame:
    """SRC-16, SUP-10: (name, provider, model, column) of the models of a run, written beside its results."""
    rows = []
    for text in models:
        provider, model, column = model_spec(text)
        if ":" not in text:
            provider = next((p for p, heads in PROVIDERS.items() if model.lower().startswith(heads)), provider)
        rows.append((text, provider, model, column))
    return spark.createDataFrame(rows, "name string, provider string, model string, column string")


def responder_for(text: str, clients: dict[str, Responder]) -> Responder:
    """SUP-10: the client of a model's provider; an error names what is missing before any question is asked."""
    provider = model_spec(text)[0]
    if provider not in clients:
        raise ValueError(f"no client for {provider}, which {text} needs; there are: {', '.join(sorted(clients)) or 'none'}")
    return clients[provider]


class Pace:
    """Lets calls begin no faster than ``rate`` a second, whichever thread makes them; None does not hold any."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = (1 / rate if rate else 0.0), clock, sleep
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def run_questions(
    questions: DataFrame, models: list[str], ask: Responder = offline, done: DataFrame | None = None, workers: int = 8, calls: int = 4, rate: float | None = None, tries: int = 3, wait: float = 2.0
) -> DataFrame:
    """Rows (task_id, model, response, seconds) for questions (task_id, prompt) not yet in ``done``.

    The model list is a parameter, so its product with the questions is bounded by it.  ``workers`` partitions keep ``calls``
    calls in flight each; together they begin at most ``rate`` calls a second, as each keeps to its part of it.  A call is
    tried ``tries`` times (``patient``); what fails for good is a row with an error text, so no task fails for it.
    """
    tasks = questions.select("task_id", "prompt", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    if done is not None:
        tasks = tasks.join(done.select("task_id", "model"), ["task_id", "model"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(rate / workers if rate else None)

        def paced(model: str, prompt: str) -> str:
            pace.wait()
            return ask(model, prompt)

        one = patient(paced, tries, wait)

        def timed(model: str, prompt: str) -> tuple[str, float]:
            began = time.time()
            return one(model, prompt), time.time() - began

        with ThreadPoolExecutor(calls) as pool:
            for b in batches:
                for k in range(0, len(b), 64 * calls):  # answers leave in order, some at a time
                    part = b.iloc[k : k + 64 * calls]
                    got = list(pool.map(timed, part["model"], part["prompt"]))
                    yield pd.DataFrame({"task_id": part["task_id"].to_numpy(), "model": part["model"].to_numpy(), "response": [r for r, _ in got], "seconds": [s for _, s in got]})

    kind = questions.schema["task_id"].dataType.simpleString()
    return tasks.select("task_id", "prompt", "model").repartition(workers, "task_id", "model").mapInPandas(run, f"task_id {kind}, model string, response string, seconds double")


def parsed(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses with their parsed fields and correctness, beside the expected answers (task_id, answer_type, answer)."""
    r = responses.join(questions.select("task_id", "answer_type", "answer"), "task_id")
    r = r.withColumn("final_answer", A.final_answer(F.col("response"), F.col("answer_type")))
    return r.select("task_id", "model", "answer_type", "answer", "final_answer", A.confidence(F.col("response")).alias("confidence"), A.reasoning_steps(F.col("response")).alias("steps"), A.correctness(F.col("answer"), F.col("final_answer"), F.col("answer_type")).alias("correctness"), F.col("response").startswith("[ERROR]").alias("error"), "seconds")


def run_with_checkpoints(questions: DataFrame, models: list[str], folder: str, ask: Responder = offline, every: int = 50, workers: int = 8) -> DataFrame:
    """SNK-8, LIM-4, SUP-12: runs in batches of ``every`` questions, each written before the next begins.

    A batch is one folder ``part=K`` of the results; ``LATEST`` names the last one with its rows.  A rerun reads what is
    there and asks only the rest, so what a broken run has paid for is never asked again.  Batches follow each other by nature:
    a later one must not begin before the earlier one is safe.
    """
    spark = questions.sparkSession
    results, latest = f"{folder}/results", f"{folder}/LATEST"
    path = spark._jvm.org.apache.hadoop.fs.Path(results)
    done, part = None, 0
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        done = spark.read.parquet(results)
        part = 1 + (done.agg(F.max("part")).first()[0] or 0)
    left = questions.select("task_id", "prompt").dropDuplicates(["task_id"])
    if done is not None:
        full = done.groupBy("task_id").agg(F.count_distinct("model").alias("n")).where(F.col("n") >= len(models))
        left = left.join(full, "task_id", "left_anti")
    batch = F.floor((F.col("_n") - 1) / every)
    left = settle(running(left, [], ["task_id"], "_n").withColumn("_b", batch))
    for k in range((left.agg(F.max("_b")).first()[0] if not left.isEmpty() else -1) + 1):
        run_questions(left.where(F.col("_b") == k), models, ask, done, workers).write.mode("overwrite").parquet(f"{results}/part={part + k}")
        rows = spark.read.parquet(f"{results}/part={part + k}").count()
        spark.createDataFrame([(part + k, rows)], "part int, rows bigint").coalesce(1).write.mode("overwrite").json(latest)
    return spark.read.parquet(results) if done is not None or not left.isEmpty() else run_questions(left.limit(0), models, ask)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """SNK-8: finished rows join the earlier ones; a rerun skips them by ``done``."""
    rows.write.mode("append").parquet(path)
