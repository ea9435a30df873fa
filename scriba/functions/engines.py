"""Recognition engines as functions over spans: a registry with what each can do, declared before it is loaded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriba.functions.columns import ColumnLike, col, lookup
from scriba.functions.text import blank_to_null

Recognise = Callable[[np.ndarray], str]


@dataclass(frozen=True)
class Engine:
    """``load`` makes the function that recognises samples; it runs once for each task."""

    id: str
    display_name: str
    load: Callable[[], Recognise]
    streaming: bool = False
    supports_hotwords: bool = False


_engines: dict[str, Engine] = {}


def register(engine: Engine) -> None:
    _engines[engine.id] = engine


def engines() -> list[Engine]:
    return [_engines[k] for k in sorted(_engines)]


def engine(name: str) -> Engine:
    if name not in _engines:
        raise KeyError(f"no engine '{name}' is registered")
    return _engines[name]


def fixed(text: str) -> Callable[[], Recognise]:
    """An engine that hears the same words in everything that isn't silent."""
    return lambda: lambda samples: text if len(samples) and float(np.abs(samples).max()) > 0 else ""


register(Engine("fixed", "Fixed words", fixed("words")))


def accepted_hotwords(name: str, hotwords: str | None) -> tuple[str | None, str | None]:
    """The vocabulary that an engine takes, and a warning where it takes none; checked before anything is loaded."""
    if hotwords is None or not hotwords.strip():
        return None, None
    if engine(name).supports_hotwords:
        return hotwords, None
    return None, f"{engine(name).display_name} takes no vocabulary; it was ignored"


def vocabulary_of(name: ColumnLike, hotwords: ColumnLike, *more: Engine) -> tuple[Column, Column]:
    """As ``accepted_hotwords``, of columns: the vocabulary that is applied, and the warning. An engine that is neither registered nor one of ``more`` is an error."""
    name, given = col(name), blank_to_null(hotwords)
    known = [*engines(), *more]
    takes = lookup(name, {e.id: e.supports_hotwords for e in known})
    unknown = F.raise_error(F.concat(F.lit("no engine '"), F.coalesce(name, F.lit("null")), F.lit("' is registered"))).cast("boolean")
    takes = F.when(takes.isNull(), unknown).otherwise(takes)
    shown = lookup(name, {e.id: e.display_name for e in known})
    return F.when(takes, given), F.when(~takes & given.isNotNull(), F.concat(shown, F.lit(" takes no vocabulary; it was ignored")))


def recognise(spans: DataFrame, name: str | Engine, samples: str = "samples") -> DataFrame:
    """``spans`` with the ``text`` an engine hears in each; the engine, registered or given, is loaded once for each task."""
    chosen = name if isinstance(name, Engine) else engine(name)
    schema = T.StructType([*spans.schema.fields, T.StructField("text", T.StringType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hear = chosen.load()
        for pdf in pdfs:
            yield pdf.assign(text=[hear(np.asarray(s, dtype=np.float32)) for s in pdf[samples]])

    return spans.mapInPandas(run, schema)


Stage = Callable[[DataFrame], DataFrame]
_pipelines: dict[str, Callable[[], Stage]] = {}


def route(kind: str, make: Callable[[], Stage]) -> None:
    """Jobs of a kind go through what ``make`` makes."""
    _pipelines[kind] = make


def pipeline_of(kind: str) -> Stage:
    """A fresh pipeline for a job of the kind; an unknown kind is an error."""
    if kind not in _pipelines:
        raise KeyError(f"no pipeline takes jobs of kind '{kind}'")
    return _pipelines[kind]()


def dispatched(jobs: DataFrame, kinds: list[str], by: str = "kind") -> DataFrame:
    """The rows of each kind through the pipeline of that kind, one after the other."""
    parts = [pipeline_of(k)(jobs.where(jobs[by] == k)) for k in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
