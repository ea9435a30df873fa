"""Segmenters: what cuts a stream of chunks into spans, one file after the other.

A segmenter takes chunks (``accept``), gives out the spans that they complete (``take``)
and, at the end of a file, what is still open (``finish``), and starts anew (``reset``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Span = tuple[int, int]


class Segmenter(Protocol):
    def accept(self, start: int, n: int, score: float) -> None: ...

    def take(self) -> list[Span]: ...

    def finish(self) -> list[Span]: ...

    def reset(self) -> None: ...


class Blocks:
    """Contiguous blocks of a fixed size; the last may be short."""

    def __init__(self, size: int):
        self.size = size
        self.reset()

    def reset(self) -> None:
        self.begin, self.end, self.ready = 0, 0, []

    def accept(self, start: int, n: int, score: float) -> None:
        self.end = start + n
        while self.end - self.begin >= self.size:
            self.ready.append((self.begin, self.size))
            self.begin += self.size

    def take(self) -> list[Span]:
        out, self.ready = self.ready, []
        return out

    def finish(self) -> list[Span]:
        out = self.take()
        if self.end > self.begin:
            out.append((self.begin, self.end - self.begin))
        self.begin = self.end
        return out


class Gaps:
    """Runs of chunks with enough speech, closed by so much silence; short runs are dropped, long ones are cut."""

    def __init__(self, threshold: float, silence: int, shortest: int, longest: int):
        self.threshold, self.silence, self.shortest, self.longest = threshold, silence, shortest, longest
        self.reset()

    def reset(self) -> None:
        self.begin, self.last, self.ready = None, 0, []

    def _close(self, end: int, cut: bool = False) -> None:
        if cut or end - self.begin >= self.shortest:
            self.ready.append((self.begin, end - self.begin))
        self.begin = end if cut else None

    def accept(self, start: int, n: int, score: float) -> None:
        if score < self.threshold:
            if self.begin is not None and start + n - self.last >= self.silence:
                self._close(self.last)
            return
        if self.begin is None:
            self.begin = start
        self.last = start + n
        while self.last - self.begin > self.longest:
            self._close(self.begin + self.longest, cut=True)

    def take(self) -> list[Span]:
        out, self.ready = self.ready, []
        return out

    def finish(self) -> list[Span]:
        if self.begin is not None:
            self._close(self.last)
        return self.take()


def segmented(chunks: DataFrame, make: Callable[[], Segmenter], file: str = "file_id") -> DataFrame:
    """``(file, start, n)``: the spans of ``chunks (file, start, n, score)``, cut by a segmenter of each task's own.

    Files are dealt out whole and sorted, and a task streams through them one after the
    other, so it holds what the segmenter does and no file.
    """
    schema = T.StructType([chunks.schema[file], T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, name = make(), None
        for pdf in pdfs:
            out = []
            for own, start, n, score in zip(pdf[file], pdf["start"], pdf["n"], pdf["score"], strict=True):
                if own != name:
                    out += [(name, *x) for x in (cutter.finish() if name is not None else [])]
                    cutter.reset()
                    name = own
                cutter.accept(start, n, score)
                out += [(own, *x) for x in cutter.take()]
            yield pd.DataFrame(out, columns=schema.names)
        if name is not None:
            yield pd.DataFrame([(name, *x) for x in cutter.finish()], columns=schema.names)

    dealt = chunks.where(chunks[file].isNotNull()).select(file, "start", "n", "score").repartition(file).sortWithinPartitions(file, "start")
    return dealt.mapInPandas(run, schema)
