"""Fingerprints, content digests and keys: SHA-256 in lower-case hex."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriba.functions.columns import ColumnLike, col

# The version of the fingerprint's meaning, and the bytes at both ends that a bounded digest reads.
SEMANTICS = "1"
WINDOW = 256 * 1024


def le8(n: ColumnLike) -> Column:
    """Eight bytes, the lowest first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(col(n).cast("long")), 16, "0"), F.lit("(..)"), 1)), ""))


def prefixed(text: Column) -> Column:
    """The text's bytes after their number."""
    return F.concat(le8(F.octet_length(text)), F.encode(text, "utf-8"))


def fingerprint(parts: ColumnLike) -> Column:
    """The digest of an array of ``(label, value)``, whatever its order; every fingerprint also has the version of its meaning."""
    own = F.array(F.struct(F.lit("semantics").alias("label"), F.lit(SEMANTICS).alias("value")))
    every = F.array_sort(F.concat(own, F.transform(col(parts), lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value")))))
    return F.sha2(F.aggregate(every, F.lit(b""), lambda a, p: F.concat(a, prefixed(p["label"]), prefixed(p["value"]))), 256)


def said(value: ColumnLike) -> Column:
    """An optional value: absent and empty are different facts."""
    return F.when(col(value).isNull(), "none").otherwise(F.concat(F.lit("some:"), col(value).cast("string")))


def _bits(kind: str, label: str, digits: int, x: ColumnLike) -> Column:
    """The bits of a column of numbers, read as one array."""

    def run(values: pd.Series) -> pd.Series:
        there = values.notna()
        raw = values[there].to_numpy(dtype=kind)
        text = np.char.add(label, np.char.zfill(np.array([x.hex() for x in raw.byteswap().view(f"V{digits // 2}").tolist()], dtype=f"U{digits}"), digits)) if len(raw) else []
        return pd.Series(text, index=values.index[there], dtype=object).reindex(values.index, fill_value=None)

    return F.pandas_udf(run, "string")(col(x))


def f32_label(x: ColumnLike) -> Column:
    """The bits of a single-precision number."""
    return _bits("<f4", "f32:", 8, x)


def f64_label(x: ColumnLike) -> Column:
    """The bits of a double-precision number."""
    return _bits("<f8", "f64:", 16, x)


def file_label(path: ColumnLike, size: ColumnLike, nanos: ColumnLike) -> Column:
    """A file by place, size and time; a missing one has no size."""
    return F.when(col(size).isNull(), "missing").otherwise(F.concat_ws("|", col(path), col(size).cast("string"), F.coalesce(col(nanos).cast("string"), F.lit("-"))))


def content_digest(content: ColumnLike, full: bool = False, window: int = WINDOW) -> Column:
    """The digest of a length and what it is of: all of it, or both ends of more than two windows."""
    content = col(content)
    n = F.octet_length(content)
    ends = F.concat(F.substring(content, F.lit(1), F.lit(window)), F.substring(content, n - window + 1, F.lit(window)))
    body = content if full else F.when(n <= 2 * window, content).otherwise(ends)
    return F.sha2(F.concat(le8(n), body), 256)


def run_key(settings: ColumnLike, content: ColumnLike) -> Column:
    return F.sha2(F.concat_ws("|", col(settings), col(content)), 256)


def span_key(start_ns: ColumnLike, samples: ColumnLike) -> Column:
    """The key of a span: its start as 16 bytes, its length as 8, its samples as single precision."""

    def run(starts: pd.Series, arrays: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(int(t).to_bytes(16, "little") + len(s).to_bytes(8, "little") + np.asarray(s, dtype="<f4").tobytes()).hexdigest() for t, s in zip(starts, arrays, strict=True)])

    return F.pandas_udf(run, "string")(col(start_ns), col(samples))


def settings_parts(settings: dict[str, ColumnLike], files: ColumnLike) -> Column:
    """What decides a run's result, as parts of a fingerprint.

    ``settings`` has the columns ``engine, itn, threads, max_output_tokens, hotwords,
    threshold, min_silence, min_speech, floor, min_energetic, decoder``; ``files`` is an
    array of ``(name, label)``, the model's own and the detector's under ``vad_model``.
    """
    s = {k: col(v) for k, v in settings.items()}
    facts = {
        "engine": s["engine"], "itn": s["itn"].cast("string"), "threads": s["threads"].cast("string"), "max_output_tokens": said(s["max_output_tokens"]), "hotwords": said(s["hotwords"]),
        "vad.threshold": f32_label(s["threshold"]), "vad.min_silence": f32_label(s["min_silence"]), "vad.min_speech": f32_label(s["min_speech"]),
        "guard.floor": f64_label(s["floor"]), "guard.min_energetic": f64_label(s["min_energetic"]), "ffmpeg": F.coalesce(s["decoder"], F.lit("unknown")),
        "model.count": F.size(F.filter(col(files), lambda f: f["name"] != "vad_model")).cast("string"),
    }
    own = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in facts.items()))
    named = F.transform(col(files), lambda f: F.struct(F.when(f["name"] == "vad_model", f["name"]).otherwise(F.concat(F.lit("model:"), f["name"])).alias("label"), f["label"].alias("value")))
    return F.concat(own, named)
