import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from scriba.functions import digests, engines, numbers, paths, text, times


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bytes: "binary", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("<|zh|><|NEUTRAL|><|Speech|><|woitn|>你好世界", "你好世界"), ("<|en|> hi <|x|>", "hi"), ("hi <|cut", "hi"), ("plain", "plain"), ("a < b | c > d", "a < b | c > d")])
def test_markers(spark, raw, want):
    assert one(spark, text.clean_markers("t"), t=raw) == want


def test_text(spark):
    assert one(spark, text.normalize("t"), t="9点ABC, ΟΣ!") == "9点abcοσ"
    assert one(spark, text.trim_ws("t"), t="　x\t ") == "x" and one(spark, text.collapse_ws("t"), t=" a \n\t b　c ") == "a b c"
    assert one(spark, text.blank_to_null("t"), t=" \t") is None and one(spark, text.blank_to_null("t"), t=" a ") == " a "
    assert one(spark, text.plural("n", "file"), n=1) == "1 file" and one(spark, text.plural("n", "file"), n=0) == "0 files"
    assert one(spark, text.describe_coverage("c", "r"), c=0.456, r=True) == "46% kept, detector lost it and the file was re-read"
    assert one(spark, text.complaint("t"), t="Input #0, wav\n  Duration: 1\n broken pipe \nGuessed Channel Layout for x\n\nno data") == "broken pipe\nno data"
    assert one(spark, text.language_code("t"), t="Cantonese") == "yue" and one(spark, text.language_code("t"), t="Klingon") is None
    assert one(spark, text.message_for("k", "m"), k="decode", m="x").endswith("：x") and one(spark, text.message_for("k", "m"), k="sink", m="x") == "x"


@pytest.mark.parametrize(("ms", "want"), [(3_661_000, "01:01:01,000"), (36_000_000, "10:00:00,000"), (0, "00:00:00,000"), (360_000_000 + 5, "100:00:00,005")])
def test_timestamps(spark, ms, want):
    assert one(spark, times.format_timestamp("n"), n=ms) == want and one(spark, times.parse_timestamp("t"), t=want) == ms


@pytest.mark.parametrize(("raw", "want"), [("00:00:01.500", 1500), ("0:0:1,5", 1005), (" 00:00:02 ", 2000), ("00:01", None), ("x", None), ("1:2:3:4", None), ("9223372036854775807:00:00,0", None)])
def test_parsed_timestamps(spark, raw, want):
    assert one(spark, times.parse_timestamp("t"), t=raw) == want


def test_stamps_of_over_999_hours_are_whole(spark, tmp_path):
    from scriba.plans import all_queries

    rows = [(k, n, 0) for k in (514_282, 514_283, 514_284, 514_285, 514_286, 514_290, 6_000_002) for n in (6, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.l_orderkey, r.l_linenumber): r.ms for r in all_queries.QUERIES["srt_timestamp_parse"](spark, str(tmp_path)).collect()}
    assert got == {(k, n): k * 1000 * n if k % 4 != 2 or k * n >= 3_600_000 else None for k, n, _ in rows}
    assert got[514_282, 7] is None and got[514_286, 7] == 3_600_002_000
    assert one(spark, times.parse_timestamp("t"), t="1000:") is None  # a cut stamp is still none


def test_times(spark):
    assert one(spark, F.struct(*times.parse_range("t")), t="00:00:01,000 --> 00:00:02,500 align:start") == (1000, 2500)
    assert one(spark, times.parse_duration_line("t"), t="  Duration: 00:00:05.59, bitrate") == 5.59 and one(spark, times.parse_duration_line("t"), t="Duration: N/A") is None
    assert one(spark, times.timecode("n"), n=6_039_999) == "100:39"
    span = one(spark, times.span_of("n"), n=5_000_000_007)
    assert (span.secs, span.nanos) == (5, 7) and one(spark, times.nanos_of(times.span_of("n")), n=5_000_000_007) == 5_000_000_007
    assert one(spark, times.chunk_nanos("n", 16_000, 2), n=3200) == 100_000_000 and one(spark, times.chunk_nanos("n", 0), n=5) == 0


def test_numbers(spark):
    assert one(spark, numbers.pool_size("t", "p", "b"), t=15, p=639_014_694, b=2 << 30) == 3 and one(spark, numbers.pool_size("t", "p", "b"), t=64, p=0, b=1) == 1
    assert one(spark, numbers.pool_size("t", "p", "b"), t=64, p=1, b=1 << 40) == 8 and one(spark, numbers.pool_size("t", "p", "b"), t=0, p=10, b=5) == 1
    assert [one(spark, numbers.human_bytes("n"), n=n) for n in (999, 1000, 1_234_567, 5_600_000_000)] == ["999 B", "1.0 KB", "1.2 MB", "5.6 GB"]
    assert one(spark, numbers.download_fraction("r", "t"), r=5, t=0) is None and one(spark, numbers.download_fraction("r", "t"), r=9, t=3) == 1.0
    assert one(spark, numbers.parse_setting("a", "b", 300), a="", b="0") == 0 and one(spark, numbers.parse_setting("a", "b", 300), a="soon", b=" ") == 300
    assert [one(spark, numbers.backoff_ms("n"), n=n) for n in (0, 1, 2)] == [400, 800, 1600]
    assert one(spark, numbers.memory_budget("n"), n=None) == 2 << 30 and one(spark, numbers.engine_threads("n"), n=1) == 1


def test_paths(spark):
    got = [(one(spark, paths.extension("p"), p=p), one(spark, paths.looks_like_audio("p"), p=p)) for p in (".mp3", "a/b.MP3", "a.b/c", "x.tar.ogg")]
    assert got == [(None, False), ("mp3", True), (None, False), ("ogg", True)]
    assert one(spark, paths.serial_name(F.lit("t"), F.lit("srt"), "n"), n=2) == "t (2).srt" and one(spark, paths.serial_of("p"), p="t (12)") == 12
    assert one(spark, paths.url_join("a", "b", "c"), a="https://x/", b="/m/n/", c="/f") == "https://x/m/n/f"
    assert one(spark, paths.is_inside("a", "b"), a="/u/OneDrive/x", b="/u/OneDrive") is True and one(spark, paths.is_inside("a", "b"), a="/u/OneDriveX", b="/u/OneDrive") is False
    assert one(spark, paths.safe_key("k"), k="") is True and one(spark, paths.safe_key("k"), k="../x") is False and one(spark, paths.safe_id("k"), k="..") is False
    assert one(spark, paths.first_directory("a", "b"), a="", b="/d") == "/d"


def le(n):
    return struct.pack("<Q", n)


def test_digests(spark):
    content = bytes(range(256)) * 3
    assert one(spark, digests.content_digest("b", window=100), b=content) == hashlib.sha256(le(768) + content[:100] + content[-100:]).hexdigest()
    assert one(spark, digests.content_digest("b", window=384), b=content) == one(spark, digests.content_digest("b", full=True), b=content) == hashlib.sha256(le(768) + content).hexdigest()
    assert one(spark, digests.run_key("a", "b"), a="s", b="c") == hashlib.sha256(b"s|c").hexdigest()
    parts = lambda *p: F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in p))
    want = hashlib.sha256(b"".join(le(len(x)) + x for kv in sorted([(b"semantics", b"1"), (b"ab", b"c" * 200), ("é".encode(), b"")]) for x in kv)).hexdigest()
    assert one(spark, digests.fingerprint(parts(("ab", "c" * 200), ("é", "")))) == one(spark, digests.fingerprint(parts(("é", ""), ("ab", "c" * 200)))) == want
    assert one(spark, digests.fingerprint(parts(("ab", "c")))) != one(spark, digests.fingerprint(parts(("a", "bc"))))
    assert one(spark, digests.f32_label("x"), x=0.5) == "f32:3f000000" and one(spark, digests.f64_label("x"), x=0.7) == f"f64:{struct.unpack('<Q', struct.pack('<d', 0.7))[0]:016x}"
    assert one(spark, digests.span_key(F.lit(7), F.array(F.lit(0.5)))) == hashlib.sha256((7).to_bytes(16, "little") + le(1) + struct.pack("<f", 0.5)).hexdigest()


def test_engines(spark):
    spans = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.0])], "seq int, samples array<float>")
    assert [(r.seq, r.text) for r in engines.recognise(spans, "fixed").orderBy("seq").collect()] == [(0, "words"), (1, "")]
    assert engines.accepted_hotwords("fixed", "a b")[0] is None and "vocabulary" in engines.accepted_hotwords("fixed", "a b")[1]
    assert engines.accepted_hotwords("fixed", "  ") == (None, None)
    with pytest.raises(KeyError, match="nothing"):
        engines.engine("nothing")
