"""Model profiles and calls of model clients from Spark tasks.

A client is any object with generate(prompt) -> str or embed(list) -> list; a
factory makes one for each task, so that nothing but the factory is shipped.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.functions.text import LINK_TYPES, link_label, parse_slug

# Profiles (slug, capabilities, general score, context tokens) and what tasks need.
PROFILES = [
    ("ollama:qwen3.5:9b", ["generation", "vision", "thinking", "structured"], 8.0, 32768),
    ("ollama:qwen3.5:7b", ["generation", "fast", "structured"], 7.0, 32768),
    ("ollama:qwen3.5:27b", ["generation", "vision", "thinking", "structured", "long-context"], 9.0, 65536),
    ("ollama:nomic-embed-text", ["embedding"], None, None),
    ("openai:gpt-4o", ["generation", "vision", "structured", "long-context"], 9.0, 128000),
    ("openai:text-embedding-3-small", ["embedding"], None, None),
    ("openai:text-embedding-3-large", ["embedding"], None, None),
]
TASKS = {
    "title-generation": ["generation", "fast"], "content-revision": ["generation"], "summarization": ["generation"], "embedding": ["embedding"], "link-typing": ["generation", "structured"],
    "chat": ["generation"], "structured-extract": ["generation", "structured"], "vision-description": ["vision"], "transcription": ["transcription"], "diarization": ["diarization"],
}
TIERS = {
    "cpu-only": ("ollama:qwen3.5:7b", "ollama:nomic-embed-text", "ollama:qwen3.5:7b"), "edge": ("ollama:qwen3.5:9b", "ollama:nomic-embed-text", "ollama:qwen3.5:9b"),
    "gpu-12gb": ("ollama:qwen3.5:9b", "ollama:nomic-embed-text", "ollama:qwen3.5:9b"), "gpu-24gb": ("ollama:qwen3.5:27b", "ollama:nomic-embed-text", "ollama:qwen3.5:27b"),
}


def profiles(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    rows = {p[0]: p for p in [*PROFILES, *more]}
    return spark.createDataFrame([(i, *p) for i, p in enumerate(rows.values())], "ord int, slug string, capabilities array<string>, general_score double, context_tokens int")


def profile(models: DataFrame, slug: str) -> DataFrame:
    """The catalogue's row of a slug; none if it isn't there."""
    return models.filter(F.col("slug") == slug)


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TASKS.items()), "task string, need array<string>")


def select_models(models: DataFrame, wanted: DataFrame, prefer_fast: bool = False, provider: str | None = None) -> DataFrame:
    """(task, slug): the best profile that has all that a task needs, the first of equals; null if none has.

    Both tables are catalogues; tasks are matched through their first need, by an equi-join.
    """
    if provider:
        models = models.filter(parse_slug(F.col("slug"))["provider"] == provider)
    by_need = models.withColumn("first_need", F.explode("capabilities"))
    met = wanted.join(by_need, wanted["need"][0] == by_need["first_need"], "left")
    score = F.coalesce("general_score", F.lit(5.0)) + (F.when(F.array_contains("capabilities", "fast"), 3).otherwise(0) if prefer_fast else 0)
    fits = F.size(F.array_except("need", "capabilities")) == 0
    return met.groupBy("task").agg(F.max_by(F.when(fits, F.col("slug")), F.when(fits, F.struct(score, -F.col("ord")))).alias("slug"))


def pick_tier(vram_gb):
    return F.when(vram_gb >= 24, "gpu-24gb").when(vram_gb >= 12, "gpu-12gb").when(vram_gb > 0, "edge").otherwise("cpu-only")


def recommended(tier):
    """struct(gen, embed, vision) of a tier."""
    out = F.lit(None).cast("struct<gen:string,embed:string,vision:string>")
    for name, models in TIERS.items():
        out = F.when(tier == name, F.struct(*[F.lit(m).alias(k) for m, k in zip(models, ("gen", "embed", "vision"), strict=True)])).otherwise(out)
    return out


_CLIENTS: dict[str, Callable] = {}


def register_client(name: str, factory: Callable) -> None:
    _CLIENTS[name] = factory


def get_client(name: str) -> Callable | None:
    return _CLIENTS.get(name)


def list_clients() -> list[str]:
    return list(_CLIENTS)


class MockClient:
    """Echoes; for tests. ``usage`` has the last call's sizes in tokens, a quarter of the characters."""

    def __init__(self, model: str = "mock"):
        self.model = model
        self.usage = {"prompt_tokens": 0.0, "completion_tokens": 0.0}

    def generate(self, prompt: str) -> str:
        reply = f"[mock:{self.model}] {prompt}"
        self.usage = {"prompt_tokens": len(prompt) / 4, "completion_tokens": len(reply) / 4}
        return reply


register_client("mock", MockClient)


def retry(call: Callable, attempts: int = 3, base: float = 0.1, most: float = 30.0, transient: Callable = lambda _: True, sleep: Callable = time.sleep):
    """The result of ``call``; waits a random part of a doubling time between attempts. The last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception as error:
            if i + 1 == attempts or not transient(error):
                raise
            sleep(min(most, base * 2**i) * random.random())


class CircuitOpen(RuntimeError):
    """Raised instead of a call while the circuit is open."""


@dataclass
class CircuitBreaker:
    """Closed until ``threshold`` failures in a row, then open for ``cooldown`` seconds, then one probe at a time.

    A failed probe doesn't start the cooldown anew: only a success closes the circuit.
    """

    threshold: int = 5
    cooldown: float = 30.0
    clock: Callable = time.monotonic
    failures: int = 0
    opened: float | None = None
    probing: bool = field(default=False, repr=False)

    def state(self) -> str:
        if self.failures < self.threshold:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.cooldown else "open"

    def run(self, call: Callable):
        state = self.state()
        if state == "open" or (state == "half-open" and self.probing):
            raise CircuitOpen("circuit is open")
        self.probing = state == "half-open"
        try:
            out = call()
        except Exception:
            self.failures += 1
            if self.failures >= self.threshold and self.opened is None:
                self.opened = self.clock()
            raise
        finally:
            self.probing = False
        self.failures, self.opened = 0, None
        return out


def generate(rows: DataFrame, factory: Callable, out: str = "reply", prompt: str = "prompt") -> DataFrame:
    """Adds a client's reply to each prompt; a client, with retries, for each task."""
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in frames:
            yield pdf.assign(**{out: [retry(lambda p=p: client.generate(p)) for p in pdf[prompt]]})

    return rows.mapInPandas(run, schema)


@dataclass
class Run:
    """What an agent loop has so far: its text, the steps it took, and whether it ended by itself."""

    text: str
    steps: list = field(default_factory=list)
    ended: bool = False


def drive(run: Run, step: Callable[[Run], None], most: int) -> Run:
    """Calls ``step`` until it ends the run, at most ``most`` times."""
    for _ in range(most):
        step(run)
        if run.ended:
            break
    return run


#: What loops ask a model by default; any other templates with the same fields can be passed.
REFINE = {"fault": "List what is wrong or weak in this text.\n\n{text}", "mend": "Write the text again without these faults, and nothing else.\n\nText:\n{text}\n\nFaults:\n{faults}"}
ACT = {"next": "Goal: {goal}\n{log}\nReply with one line 'Thought: ...' and one line 'Action: ...'; the action FINISH ends.", "last": "Goal: {goal}\n{log}\nGive the result."}
LEARN = {"why": "An attempt at this task failed. Say in short what to change.\n\n{task}\n\nAttempt:\n{text}", "again": "{task}\n\nKeep in mind:\n{lessons}"}


def self_refine(draft: str, say: Callable, rounds: int = 3, stop: Callable | None = None, ask: dict = REFINE) -> tuple[str, int]:
    """(text, times mended): a critique, then a new text, until ``stop(text, critique)`` or the last round."""

    def step(run: Run) -> None:
        faults = say(ask["fault"].format(text=run.text))
        run.ended = bool(stop and stop(run.text, faults))
        if not run.ended:
            run.text = say(ask["mend"].format(text=run.text, faults=faults)).strip()
            run.steps.append(faults)

    run = drive(Run(draft), step, rounds)
    return run.text, len(run.steps)


def react(goal: str, say: Callable, act: Callable, done: Callable = lambda _: False, most: int = 8, ask: dict = ACT) -> tuple[list[tuple[str, str, str]], str]:
    """((thought, action, observation) by step, final text). A reply without action, or with FINISH, ends with its thought."""
    log = lambda run: "\n".join(f"{name} {i}: {part}" for i, s in enumerate(run.steps, 1) for name, part in zip(("Thought", "Action", "Observation"), s, strict=True))

    def step(run: Run) -> None:
        reply = say(ask["next"].format(goal=goal, log=log(run)))
        parts = dict(re.findall(r"(?ms)^\s*(Thought|Action)[^:\n]*:\s*(.*?)\s*(?=^\s*(?:Thought|Action|Observation)[^:\n]*:|\Z)", reply))
        thought, action = parts.get("Thought", reply.strip()), parts.get("Action", "FINISH")
        if action == "FINISH":
            run.text, run.ended = thought, True
            return
        run.steps.append((thought, action, act(action)))
        if done(run.steps):
            run.text, run.ended = say(ask["last"].format(goal=goal, log=log(run))).strip(), True

    run = drive(Run(""), step, most)
    return run.steps, run.text if run.ended else say(ask["last"].format(goal=goal, log=log(run))).strip()


def reflexion(task: str, say: Callable, good: Callable, most: int = 3, ask: dict = LEARN) -> tuple[str, int, list[str]]:
    """(text, attempts, lessons): each attempt after the first comes with a lesson drawn from the one before."""
    tries = []

    def step(run: Run) -> None:
        if tries:
            run.steps.append(say(ask["why"].format(task=task, text=run.text)).strip())
        lessons = "\n".join(f"- {lesson}" for lesson in run.steps)
        run.text = say(ask["again"].format(task=task, lessons=lessons) if tries else task)
        tries.append(run.text)
        run.ended = bool(good(run.text))

    run = drive(Run(""), step, max(1, most))
    return run.text, len(tries), run.steps


#: What a model is asked for the type of a link.
LINK_PROMPT = "Which of these labels fits how the source relates to the target: {labels}? Reply with the label alone.\nSource: {source}\nTarget: {target}\nText: {evidence}"


def typed_by_model(links: DataFrame, factory: Callable, template: str = LINK_PROMPT) -> DataFrame:
    """Adds ``type`` to links (source, target, evidence) by a client's reply; replies that are no label count as mentions."""
    pieces = re.split(r"\{(\w+)\}", template)
    said = {"labels": F.lit(", ".join(LINK_TYPES))}
    parts = [said.get(p, F.coalesce(F.col(p), F.lit(""))) if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    replied = generate(links.withColumn("__prompt", F.concat(*parts)), factory, "__reply", "__prompt")
    return replied.withColumn("type", link_label(F.col("__reply"))).drop("__prompt", "__reply")


def run_loops(rows: DataFrame, factory: Callable, loop: Callable, schema: str) -> DataFrame:
    """(id, ...) of ``loop(client, text)`` -> dict for rows (id, text): agent loops spread over tasks."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in frames:
            yield pd.DataFrame([{"id": i, **loop(client, t)} for i, t in zip(pdf["id"], pdf["text"], strict=True)], columns=["id", *names])

    return rows.select("id", "text").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, {schema}")
