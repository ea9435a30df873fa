"""Table functions for SQL: ``SELECT ... FROM documents, LATERAL parse_srt(text)``.

``register`` makes them known to a session. Each call sees one value, so they take no
shuffle; whole tables of subtitles are cut up without Python by ``operators.subtitles``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scriba.operators.punctuation import align

_LONG = 2**63
_STAMP = re.compile(r"(\d+):(\d+):(\d+)(?:[,.](\d+))?", re.ASCII)
#: White space as Unicode has it, which Python's own isn't.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$")
_BLANK = re.compile(f"\n(?:[{_SPACE.replace(chr(10), '')}]*\n)+")
_TOKEN = re.compile(f"[{_SPACE}]*([^{_SPACE}]+)")


def _milliseconds(text: str) -> int | None:
    m = _STAMP.fullmatch(_ENDS.sub("", text))
    if not m:
        return None
    h, mins, s, f = (int(x or 0) for x in m.groups())
    ms = ((h * 60 + mins) * 60 + s) * 1000 + f
    return ms if ms < _LONG else None


def cues_of(document: str | None) -> Iterator[tuple[int, int, int, str]]:
    """``seg_id, start_ms, end_ms, text`` of a subtitle document, by the rules of ``operators.subtitles.parse_srt``."""
    n = 0
    for block in _BLANK.split(re.sub("\r\n?", "\n", document or "")):
        lines = block.split("\n")
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        before, _, after = lines[at].partition("-->")
        end = _TOKEN.match(after)
        times = _milliseconds(before), _milliseconds(end.group(1)) if end else None
        text = _ENDS.sub("", "\n".join(lines[at + 1 :]))
        if None not in times and text:
            yield n, *times, text
            n += 1


class ParseSrt:
    def eval(self, document: str) -> Iterator[tuple[int, int, int, str]]:
        yield from cues_of(document)


class Align:
    def eval(self, reference: str, hypothesis: str) -> Iterator[tuple[int, int | None, int | None, str | None, str | None]]:
        a, b = reference or "", hypothesis or ""
        for n, (i, j) in enumerate(align(a, b)):
            yield n, i, j, None if i is None else a[i], None if j is None else b[j]


def register(spark: SparkSession) -> None:
    """``parse_srt(document)``: the cues of a subtitle file. ``align_chars(reference, hypothesis)``: the steps of a cheapest alignment; a side that a step lacks is null."""
    spark.udtf.register("parse_srt", udtf(ParseSrt, returnType="seg_id int, start_ms bigint, end_ms bigint, text string"))
    spark.udtf.register("align_chars", udtf(Align, returnType="step int, ref_pos int, hyp_pos int, ref_char string, hyp_char string"))
