"""Text providers: responses to prompts, with validation and retries; chat messages, and a connector for chat services.

A provider is called in the tasks, a bounded number of prompts at a time; responses are rows keyed by the prompt's id, in the order in which they come.
"""

from __future__ import annotations

import base64
import json
import random
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed
from concurrent.futures import wait as wait_for

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scene_rules import scene_error

RESPONSE = "id long, response string, status string, calls int"


def recorded(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """The offline provider: recorded (id, response) for the prompts; those without one have the status ``missing``."""
    joined = prompts.select("id").join(responses.select("id", "response"), "id", "left")
    return joined.withColumn("status", F.when(F.col("response").isNull(), "missing").otherwise("ok")).withColumn("calls", F.lit(0))


def ask(prompts: DataFrame, call: Callable[[str], str | None], valid: Callable[[str], bool] = bool, concurrency: int = 10, retries: int = 3, wait: float = 1.0, tasks: int | None = None) -> DataFrame:
    """(id, response, status, calls) of ``prompts`` (id, prompt), answered by ``call``.

    A call that raises is repeated after ``wait``, twice that, and so on; a response that isn't valid is asked for again. After
    ``retries`` repetitions the status is ``error`` or ``invalid`` and the response null. ``tasks`` partitions with
    ``concurrency`` calls each run at a time: one partition for each key keeps a key's load bounded.
    """

    def one(prompt: str) -> tuple[str | None, str, int]:
        status = "invalid"
        for k in range(retries + 1):
            try:
                text = call(prompt)
            except Exception:  # whatever the service raises counts as a failed call
                status = "error"
                time.sleep(wait * 2**k if k < retries else 0)
                continue
            if text is not None and valid(text):
                return text, "ok", k + 1
            status = "invalid"
        return None, status, retries + 1

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(pairs):
            return pd.DataFrame([(i, *f.result()) for i, f in pairs], columns=["id", "response", "status", "calls"])

        with ThreadPoolExecutor(concurrency) as pool:
            open_: dict = {}
            for batch in batches:
                for i, prompt in zip(batch["id"], batch["prompt"]):
                    open_[pool.submit(one, prompt)] = i
                    if len(open_) >= 4 * concurrency:  # whoever is done first goes out first; a slow call holds no other back
                        ready, _ = wait_for(open_, return_when=FIRST_COMPLETED)
                        yield made([(open_.pop(f), f) for f in list(ready)])
            if open_:
                yield made([(open_.pop(f), f) for f in as_completed(list(open_))])

    rows = prompts.select(F.col("id").cast("long").alias("id"), "prompt")
    return (rows.repartition(tasks, "id") if tasks else rows).mapInPandas(each, RESPONSE)


def call_stats(responses: DataFrame) -> DataFrame:
    """calls, errors and retries over all prompts."""
    return responses.agg(F.sum("calls").alias("calls"), F.count_if(F.col("status") != "ok").alias("errors"), F.sum(F.greatest(F.col("calls") - 1, F.lit(0))).alias("retries"))


SYSTEM = """You describe scenes of a few objects as JSON. Answer with one JSON object and nothing else.

Fields:
- description: one or two sentences that name every object exactly as it was given.
- objects: a list; each object has a name, a size (largest, large, medium, small or smallest) and a rotation about the vertical axis in degrees.
  At least one object is "largest" and at least one is "smallest".
- relations: a list; each has a subject, a relation and a reference, both names of different objects. Relations are: in front of, behind, to the left of,
  to the right of, beside, next to, near, far from, on, above, below, under, surrounding, at the center of.

An object without a relation stands anywhere. Relations must not run in circles.

Example for ["desk", "lamp"]:
{"description": "A lamp stands on the desk.", "objects": [{"name": "desk", "size": "largest", "rotation": 0}, {"name": "lamp", "size": "smallest", "rotation": 45}], "relations": [{"subject": "lamp", "relation": "on", "reference": "desk"}]}

Example for ["sofa", "rug", "cup"]:
{"description": "A rug is in front of the sofa, and a cup is on the rug.", "objects": [{"name": "sofa", "size": "largest", "rotation": 180}, {"name": "rug", "size": "medium", "rotation": 0}, {"name": "cup", "size": "smallest", "rotation": 0}], "relations": [{"subject": "rug", "relation": "in front of", "reference": "sofa"}, {"subject": "cup", "relation": "on", "reference": "rug"}]}

Example for ["tree", "bench"]:
{"description": "The bench is near the tree.", "objects": [{"name": "tree", "size": "largest", "rotation": 0}, {"name": "bench", "size": "smallest", "rotation": 90}], "relations": [{"subject": "bench", "relation": "near", "reference": "tree"}]}
"""

#: Models that are asked to reason: the reply goes on from an opening mark.
REASONING = ("deepseek-r1",)


def chat_messages(prompt: Column, system: Column, reasoning: bool = False) -> Column:
    """The messages of a chat as JSON text: the system's, the user's and, for a reasoning model, the opening of its thoughts."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rows = [one("system", system), one("user", prompt)]
    if reasoning:
        rows.append(one("assistant", F.lit("<think>\n")))
    return F.to_json(F.array(*rows))


def video_url(frames: Column) -> Column:
    """The data URL of a video: its frames (array of JPEG bytes) in base 64, comma-joined."""
    return F.concat(F.lit("data:video/jpeg;base64,"), F.array_join(F.transform(frames, lambda f: F.replace(F.base64(f), F.lit("\r\n"), F.lit(""))), ","))


def content(parts: list[dict]) -> list[dict]:
    """The parts of a message: texts as they are, a video's frames as one data URL; images aren't supported."""
    made = []
    for part in parts:
        if part.get("type") == "video":
            frames = ",".join(base64.b64encode(f).decode() for f in part["frames"])
            made.append({"type": "video_url", "video_url": {"url": f"data:video/jpeg;base64,{frames}"}})
        elif part.get("type") == "image":
            raise NotImplementedError("images aren't supported")
        else:
            made.append(part)
    return made


def read_keys(text: str) -> list[str]:
    """The keys of a document like ``keys:`` and a line ``- key`` for each, or ``keys: [a, b]``."""
    made, inside = [], False
    for line in text.splitlines():
        line = line.split(" #", 1)[0].rstrip()
        if line.startswith("keys:"):
            inside, rest = True, line[5:].strip()
            if rest.startswith("["):
                made += [k.strip().strip("'\"") for k in rest.strip("[]").split(",") if k.strip()]
        elif inside and line.strip().startswith("-"):
            made.append(line.strip()[1:].strip().strip("'\""))
        elif line.strip() and not line.startswith((" ", "#")):
            inside = False
    if not made:
        raise ValueError("no keys")
    return made


class KeyPool:
    """Calls by the least busy of several keys, a random one of them on ties; no key has more than ``limit`` calls at a time."""

    def __init__(self, keys: list[str], limit: int = 10, seed: int | None = None):
        if not keys:
            raise ValueError("no keys")
        self.keys, self.limit = keys, limit
        self.busy, self.calls, self.errors = [0] * len(keys), [0] * len(keys), 0
        self._rng, self._turn = random.Random(seed), threading.Condition()

    def __getstate__(self):  # each task has a pool of its own
        return {"keys": self.keys, "limit": self.limit}

    def __setstate__(self, state):
        self.__init__(**state)

    def run(self, call: Callable[[str], str | None]) -> str | None:
        with self._turn:
            while min(self.busy) >= self.limit:
                self._turn.wait()
            k = self._rng.choice([i for i, b in enumerate(self.busy) if b == min(self.busy)])
            self.busy[k] += 1
            self.calls[k] += 1
        try:
            return call(self.keys[k])
        except Exception:
            with self._turn:
                self.errors += 1
            raise
        finally:
            with self._turn:
                self.busy[k] -= 1
                self._turn.notify()


class Chat:
    """A connector for chat services that take ``messages`` and give ``choices``: ``call`` for ``ask``. Its keys are shared as a ``KeyPool``."""

    def __init__(self, url: str, model: str, keys: list[str], system: str = SYSTEM, limit: int = 10, timeout: float = 120.0):
        self.url, self.model, self.system, self.timeout = url, model, system, timeout
        self.pool = KeyPool(keys, limit)

    def messages(self, prompt: str | list[dict]) -> list[dict]:
        made = [{"role": "system", "content": self.system}, {"role": "user", "content": content(prompt) if isinstance(prompt, list) else prompt}]
        if self.model.lower() in REASONING:
            made.append({"role": "assistant", "content": "<think>\n"})
        return made

    def reply(self, prompt: str | list[dict]) -> dict:
        """The ``answer``, and the ``rational`` of a reasoning model, empty for others."""
        body = json.dumps({"model": self.model, "messages": self.messages(prompt), "stream": False, "temperature": 1}).encode()

        def send(key: str) -> str:
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=self.timeout) as got:
                return got.read().decode()

        said = json.loads(self.pool.run(send))["choices"][0]["message"]
        return {"answer": said.get("content"), "rational": said.get("reasoning_content") or ""}

    def __call__(self, prompt: str) -> str | None:
        return self.reply(prompt)["answer"]


def valid_scene(text: str) -> bool:
    """Whether a response is a valid scene description, by the rules of ``operators.dsl.validate``: the test that a retry needs."""
    return scene_error(text) is None
