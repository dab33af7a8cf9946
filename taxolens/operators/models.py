"""Models of other makers: encoders and scorers behind protocols, with caches.

A model is named ``module:factory``; the factory is called once a Python worker and gives
an object with an ``identity`` (a dict that names model and pinned revision). Answers are
kept in tables by a key of identity and input, so a model is asked each thing once.
"""

from __future__ import annotations

import importlib
import json
import math
import re
import urllib.request
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.functions.text import label_text
from taxolens.operators.cache import Cache, CacheError
from taxolens.operators.components import store
from taxolens.session import ship

# The widest question, how a request is worded, how exact probabilities come.
MOST_OPTIONS = 255
INSTRUCTIONS = "Choose the research subject that best describes this record using its metadata."
EXACT = "full-precision-choice-v1"
TIMEOUT = 180
#: A unit vector's square may be off by so much.
UNIT = 1e-3


class ModelError(RuntimeError):
    """A model that isn't there, isn't pinned or breaks its contract."""


class Encoder(Protocol):
    """Texts to vectors of length 1 and whether each text was cut to fit."""

    identity: dict

    def encode(self, texts: list[str]) -> list[tuple[list[float], bool]]: ...


class Chooser(Protocol):
    """Probabilities of the options (id: name) for a text."""

    identity: dict

    def probabilities(self, text: str, options: dict[str, str]) -> dict[str, float]: ...


@lru_cache(maxsize=4)
def load(name: str):
    """The model of a factory ``module:factory``, one a process."""
    try:
        module, factory = name.split(":")
        model = getattr(importlib.import_module(module), factory)()
    except (ValueError, ImportError, AttributeError) as e:
        raise ModelError(f"no model by the name {name}: {e}") from e
    pinned(model.identity)
    return model


def pinned(identity: dict) -> None:
    """A moving name must not share answers with another checkpoint."""
    if not identity.get("model") or not re.fullmatch(r"[0-9a-f]{40}([0-9a-f]{24})?", str(identity.get("revision", ""))):
        raise ModelError("a model's identity needs its name and a revision or fingerprint of 40 or 64 hex digits")


def keyed(identity: dict, *columns: str):
    """The key of an answer: a digest of the model's identity and its input."""
    return F.sha2(F.concat_ws("\n", F.lit(json.dumps(identity, sort_keys=True)), *columns), 256)


def opened(spark: SparkSession, folder: str, schema: str) -> Cache:
    """The cache in a folder, which may be new."""
    try:
        cache = Cache(spark, folder, schema)
        cache.stored()
        return cache
    except CacheError as e:
        raise ModelError(str(e)) from e


# ---- encoders -----------------------------------------------------------------------------

VECTORS = "key string, vector array<double>, truncated boolean"


def encoded(texts: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """(text, vector, truncated) of the distinct texts of ``texts``. What the cache in
    ``folder`` lacks is encoded in Arrow batches and added to it."""
    spark = texts.sparkSession
    ship(spark)
    identity = load(name).identity
    asked = store(texts.select("text").where("text is not null").distinct().withColumn("key", keyed(identity, "text")), "texts")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    fine = (F.size("vector") > 0) & (F.abs(square - 1) <= UNIT)
    held = opened(spark, folder, VECTORS) if folder else None
    missing = held.missing(asked) if held else asked

    def run(batches):
        model = load(name)
        for batch in batches:
            found = model.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([list(map(float, v)) for v, _ in found], pa.list_(pa.float64())), pa.array([bool(t) for _, t in found])], ["key", "vector", "truncated"])

    fresh = store(missing.select("key", "text").mapInArrow(run, VECTORS), "vectors")
    if not fresh.where(~F.coalesce(fine, F.lit(False))).isEmpty():
        raise ModelError("the encoder gave a vector that isn't finite or not of length 1")
    if held:
        held.add(fresh)
    out = store((held.found(asked) if held else asked.join(fresh, "key")).select("text", "vector", "truncated"), "encoded")
    about = out.agg(F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if about["bad"]:
        raise ModelError(f"the cache of vectors in {folder} is broken")
    if about["least"] != about["most"]:
        raise ModelError("vectors differ in their dimensions; the cache may hold old ones")
    return out


# ---- scorers ------------------------------------------------------------------------------


def checked(found: dict, options: dict[str, str]) -> dict[str, float]:
    """Probabilities of exactly the options, finite, in [0, 1] and of sum 1, made exact."""
    if not isinstance(found, dict) or found.keys() != options.keys():
        raise ModelError("labels were omitted or invented")
    numbers = [v for v in found.values() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    total = math.fsum(numbers) if len(numbers) == len(found) else math.nan
    if not all(0 <= v <= 1 for v in numbers) or not math.isclose(total, 1, rel_tol=1e-4, abs_tol=1e-5):
        raise ModelError("invalid probabilities")
    return {k: v / total for k, v in found.items()}


class ChoiceScorer:
    """A ``Chooser`` as a scorer: one question a record, with all its options, in Arrow
    batches. ``texts``: work_id, text; ``names``: per level option_id, option_name, which
    go to the model without brackets (``label_text``)."""

    named = staticmethod(label_text)

    def __init__(self, name: str, texts: DataFrame, names: dict[str, DataFrame]):
        self.name, self.texts, self.names = name, texts, names
        self.identity = self._model().identity

    def _model(self):
        return load(self.name)

    def logits(self, asked: DataFrame, level: str) -> DataFrame:
        """Logarithms of probabilities, which a softmax turns back into them."""
        option = F.struct("option_id", self.named(F.col("option_name")).alias("option_name"))
        questions = asked.join(self.names[level], "option_id").groupBy("work_id").agg(F.sort_array(F.collect_list(option)).alias("options")).join(self.texts, "work_id")
        texts_and_options = questions.select("work_id", "text", F.to_json("options").alias("options"))
        model_of = self._ask()

        def run(batches):
            for batch in batches:
                out = []
                for work, text, options in zip(*(c.to_pylist() for c in batch.columns)):
                    options = {o["option_id"]: o["option_name"] for o in json.loads(options)}
                    out += [(work, k, math.log(p) if p > 0 else -745.0) for k, p in checked(model_of(text, options), options).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["work_id", "option_id", "logit"])

        return texts_and_options.mapInArrow(run, "work_id string, option_id string, logit double")

    def _ask(self):
        name = self.name
        return lambda text, options: load(name).probabilities(text, options)


def post(url: str, payload: dict | None = None, opener=urllib.request.urlopen) -> dict:
    """The JSON answer to a request (GET without a payload)."""
    request = urllib.request.Request(url, None if payload is None else json.dumps(payload).encode(), {"Content-Type": "application/json"})
    try:
        with opener(request, timeout=TIMEOUT) as answer:
            return json.loads(answer.read())
    except (OSError, ValueError) as e:
        raise ModelError(f"the model at {url} gave no answer: {e}") from e


class HttpScorer(ChoiceScorer):
    """A model behind HTTP: ``GET /v1/models`` and ``/provenance`` describe it, ``POST
    /choice-probabilities`` answers a question about a text, with names as they are."""

    named = staticmethod(lambda c: c)

    def __init__(self, url: str, texts: DataFrame, names: dict[str, DataFrame], expected: str | None = None):
        self.url = url.rstrip("/")
        self.identity = described(post(f"{self.url}/v1/models"), post(f"{self.url}/provenance"), expected)
        self.texts, self.names = texts, names

    def _ask(self):
        url = f"{self.url}/choice-probabilities"

        def ask(text: str, options: dict[str, str]) -> dict[str, float]:
            if not 0 < len(options) <= MOST_OPTIONS:
                raise ModelError(f"a question has 1 to {MOST_OPTIONS} options, not {len(options)}")
            found = post(url, {"state": text, "questions": {"subject": {"type": "choice", "instructions": INSTRUCTIONS, "criteria": options}}})
            return found.get("answers", {}).get("subject", {}).get("probabilities")

        return ask


def described(models: dict, provenance: dict, expected: str | None = None) -> dict:
    """The identity of a served model, which must be the expected one and fingerprinted."""
    listed = models.get("models") or [{}]
    served = listed[0].get("run")
    if expected not in (None, served):
        raise ModelError(f"the server has {served}, not {expected}")
    if provenance.get("probability_api") != EXACT:
        raise ModelError("the server does not give probabilities in full precision")
    identity = {"scorer": "http", "model": served, "revision": provenance.get("fingerprint"), "scoring": EXACT} | {k: listed[0].get(k) for k in ("base", "device", "dtype", "temperature")}
    pinned(identity)
    return identity


class CachedScorer:
    """A scorer with a table of its answers, keyed by model, level, option and text."""

    SCHEMA = "key string, logit double"

    def __init__(self, scorer, texts: DataFrame, folder: str):
        self.scorer, self.texts, self.folder, self.identity = scorer, texts, folder, scorer.identity

    def logits(self, asked: DataFrame, level: str) -> DataFrame:
        spark = asked.sparkSession
        mine = asked.join(self.texts, "work_id").select("work_id", "option_id", keyed(self.identity | {"level": level}, "option_id", "text").alias("key"))
        held = opened(spark, self.folder, self.SCHEMA)
        missing = store(held.missing(mine), "missing")
        fresh = self.scorer.logits(missing.select("work_id", "option_id"), level).join(missing, ["work_id", "option_id"])
        held.add(fresh.select("key", "logit").distinct())
        broken = F.raise_error(F.lit(f"the cache of scores in {self.folder} is broken"))
        return held.found(mine).select("work_id", "option_id", F.when(F.col("logit").isNull() | F.isnan("logit"), broken).otherwise(F.col("logit")).alias("logit"))
