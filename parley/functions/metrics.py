"""User metrics as vectorised functions over turns or conversations, given as functions or found in files."""

from __future__ import annotations

import hashlib
import inspect
import types
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.tables import materialize
from parley.operators.turns import conversation_keys


@dataclass
class QuantMetric:
    """A metric that gives a number, or (number, reason), for one row's inputs."""

    name: str
    fn: Callable
    inputs: list[str]
    score_range: tuple[float, float] = (1, 5)
    scope: str = "turn"
    additional_input: dict = field(default_factory=dict)
    kind = "double"


@dataclass
class QualMetric(QuantMetric):
    """A metric that gives a label, or (label, reason)."""

    kind = "string"


class NumberMetric:
    """Base of metric classes in users' files: score(**inputs) gives a number, or (number, reason). The name is the class's, unless set."""

    name: str | None = None
    inputs: list[str] = ["user_msg", "assistant_msg"]
    score_range: tuple[float, float] = (1, 5)
    scope = "turn"
    additional_input: dict = {}

    def score(self, **inputs):
        raise NotImplementedError


class LabelMetric(NumberMetric):
    """The same for labels."""


_modules: dict[str, types.ModuleType] = {}


def _module(source: str, path: str) -> types.ModuleType:
    """The module of a source text; its top level runs once in each Python process."""
    at = hashlib.sha256(source.encode()).hexdigest()
    if at not in _modules:
        module = types.ModuleType(f"user_metrics_{at[:16]}")
        module.__file__ = path
        exec(compile(source, path, "exec"), module.__dict__)  # noqa: S102 - the user's own code, as given
        _modules[at] = module
    return _modules[at]


class _FromSource:
    """Calls a class of a source text; only the text travels to the executors, where the class is made once a task."""

    def __init__(self, source: str, path: str, cls: str):
        self.source, self.path, self.cls, self.made = source, path, cls, None

    def __getstate__(self):
        return {**self.__dict__, "made": None}

    def __call__(self, **inputs):
        if self.made is None:
            self.made = getattr(_module(self.source, self.path), self.cls)()
        return self.made.score(**inputs)


def load_metrics(paths: list[str]) -> list[QuantMetric]:
    """The metrics of Python files on the driver, in the order of files and, within one, of names.

    A metric is each subclass of NumberMetric or LabelMetric that has its own
    score. Classes have to come without arguments; one that can't be made ends
    the job before it begins.
    """
    out: list[QuantMetric] = []
    for path in paths:
        if not path.endswith(".py"):
            raise ValueError(f"no Python file: {path}")
        with open(path, encoding="utf-8") as f:
            source = f.read()
        module = _module(source, path)
        for name, cls in inspect.getmembers(module, inspect.isclass):
            if not issubclass(cls, NumberMetric) or cls.score is NumberMetric.score or inspect.isabstract(cls):
                continue
            try:
                made = cls()
            except Exception as e:
                raise RuntimeError(f"metric {name} of {path} can't be made: {e}") from e
            kind = QualMetric if issubclass(cls, LabelMetric) else QuantMetric
            out.append(kind(made.name or name, _FromSource(source, path, name), list(made.inputs), tuple(made.score_range), made.scope, dict(made.additional_input)))
    return out


def score_all(rows: DataFrame, metrics: list[QuantMetric]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers, labels, errors) of metrics of one scope, all in one Python stage.

    A call that raises is an error of its row and metric; the others stay. Each
    metric is called once a row: results are written before they are parted.
    """
    scopes = {m.scope for m in metrics}
    if len(scopes) != 1 or len({m.name for m in metrics}) < len(metrics):
        raise ValueError("metrics of one scope and of different names are scored together")
    scope = scopes.pop()
    given = [(m.name, m.fn, m.inputs, m.additional_input, m.kind == "double") for m in metrics]
    inputs = sorted({c for m in metrics for c in m.inputs})

    @F.pandas_udf("array<struct<name:string,number:double,label:string,reason:string,error:string>>")
    def run(asked: pd.DataFrame) -> pd.Series:
        out = []
        for row in asked.to_dict("records"):
            found = []
            for name, fn, own, extra, number in given:
                one = {"name": name, "number": None, "label": None, "reason": None, "error": None}
                try:
                    got = fn(**{c: row[c] for c in own}, **extra)
                    value, one["reason"] = got if isinstance(got, tuple) else (got, None)
                    one["number" if number else "label"] = float(value) if number else str(value)
                except Exception as e:  # noqa: BLE001 - a user's metric may fail in any way, and then only its own row is lost
                    one["reason"], one["error"] = None, f"{type(e).__name__}: {e}"
                found.append(one)
            out.append(found)
        return pd.Series(out)

    keys = [*conversation_keys(rows), *(["turn_id"] if scope == "turn" else [])]
    done = rows.select(*keys, F.explode(run(F.struct(*inputs))).alias("s")).select(*keys, "s.name", F.lit(scope).alias("scope"), "s.reason", "s.number", "s.label", "s.error")
    done = materialize(done, "metrics")
    good = done.where("error is null")
    numbers = good.where("number is not null").select(*keys, "name", "scope", F.col("number").alias("value"), "reason")
    labels = good.where("label is not null").select(*keys, "name", "scope", F.col("label").alias("value"), "reason")
    return numbers, labels, done.where("error is not null").select(*keys, "name", "scope", "error")


def score_with(rows: DataFrame, metric: QuantMetric) -> tuple[DataFrame, DataFrame]:
    """(scores, errors) of one metric."""
    numbers, labels, errors = score_all(rows, [metric])
    return (numbers if metric.kind == "double" else labels), errors
