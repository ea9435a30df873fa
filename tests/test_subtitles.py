from scriba.operators import subtitles


def test_render_numbers_after_leaving_out_blanks_and_reads_back(spark):
    rows = [("f", 0, 0, 1500, " hi "), ("f", 1, 1500, 2000, "  "), ("f", 2, 3_661_000, 36_000_000, "two\nlines"), ("g", 0, 0, 1, "")]
    segments = spark.createDataFrame(rows, "file_id string, seg_id int, start_ms long, end_ms long, text string")
    srt = {r.file_id: r.srt for r in subtitles.to_srt(segments).collect()}
    assert srt == {"f": "1\n00:00:00,000 --> 00:00:01,500\nhi\n\n2\n01:01:01,000 --> 10:00:00,000\ntwo\nlines\n\n"}
    back = subtitles.parse_srt(subtitles.to_srt(segments), "srt", "file_id")
    assert [(r.seg_id, r.start_ms, r.end_ms, r.text) for r in back.orderBy("seg_id").collect()] == [(0, 0, 1500, "hi"), (1, 3_661_000, 36_000_000, "two\nlines")]
    again = subtitles.to_srt(back).first().srt
    assert again == srt["f"]


def test_text_keeps_blank_lines_but_not_empty_ones_at_the_start(spark):
    rows = [("a", 0, ""), ("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("b", 0, ""), ("c", 0, " "), ("c", 1, "z")]
    got = {r.file_id: r.txt for r in subtitles.to_text(spark.createDataFrame(rows, "file_id string, seg_id int, text string")).collect()}
    assert got == {"a": "x\n\ny\n", "b": "", "c": " \nz\n"}


def test_tolerant_parsing(spark):
    doc = "WEBVTT header\n\n7\n00:00:01.000 --> 00:00:02,500 align:start\nfirst\n \n3\nnonsense --> 00:00:01,000\nlost\n\n00:00:03,000 --> 00:00:04,000\r\nsecond\r\nline\n\n9\n00:00:05,000 --> 00:00:06,000\n\n"
    rows = spark.createDataFrame([(1, doc), (2, "no cue at all"), (3, " \n ")], "k int, doc string")
    got = subtitles.parse_srt(rows, "doc", "k").orderBy("k", "seg_id").collect()
    assert [(r.k, r.seg_id, r.start_ms, r.text) for r in got] == [(1, 0, 1000, "first"), (1, 1, 3000, "second\nline")]
    assert {r.k: r.cues for r in subtitles.parses(rows, "doc", "k").collect()} == {1: 2, 2: None, 3: 0}
