import json

import numpy as np
import pytest

from scriba.operators import catalogue
from scriba.sources import files, pcm


def test_manifest(spark, tmp_path):
    folder = tmp_path / "meeting"
    folder.mkdir()
    (folder / "m.tsv").write_text("1\twav/1.wav\t你好\tmore\r\n2\twav/2.wav\t\"quoted\n", encoding="utf-8")
    rows = files.read_manifest(spark, str(folder / "m.tsv")).orderBy("line").collect()
    assert [(r.dataset, r.line, r.utt_id, r.reference) for r in rows] == [("meeting", 1, "1", "你好\tmore"), ("meeting", 2, "2", '"quoted')]
    assert rows[0].path.endswith("/meeting/wav/1.wav")
    (folder / "bad.tsv").write_text("1\ta\tb\n\n3\tc\td\n")
    with pytest.raises(Exception, match="line 2 needs three fields"):
        files.read_manifest(spark, str(folder / "bad.tsv")).collect()


def test_folders(spark, tmp_path):
    for name in ("a/x.MP3", "a/b/y.wav", "a/notes.txt", "a/z.part", "a/big.part"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (9 if "big" in name else 3))
    got = [r.path.rpartition("/")[2] for r in files.expand_inputs(spark, [str(tmp_path)], ["odd.xyz", "odd.xyz"]).collect()]
    assert sorted(got) == ["odd.xyz", "x.MP3", "y.wav"]
    assert [r.name for r in files.partial_files(spark, str(tmp_path)).collect()] == ["big.part", "z.part"]
    with pytest.raises(ValueError, match="no audio"):
        files.expand_inputs(spark, [], [])


def test_stored_documents(spark, tmp_path):
    span = {"secs": 1, "nanos": 7}
    entry = {"version": 1, "transcript": {"segments": [{"id": 0, "start": span, "end": span, "text": "t"}], "language": "en"}, "coverage": {"decoded_seconds": 1.0, "voiced_seconds": 1.0, "energetic_seconds": 1.0}, "recovered": False}
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "abc1.json").write_text(json.dumps(entry))
    (cache / "abc2.json").write_text(json.dumps(entry | {"version": 2}))
    (cache / "abc3.json").write_text("{cut")
    got = files.read_cache(spark, str(cache)).collect()
    assert [(r.key, r.transcript.segments[0].start.nanos) for r in got] == [("abc1", 7)]
    log = tmp_path / "run-1.jsonl"
    log.write_text("\n".join(json.dumps({"span": s, "segments": [{"id": i, "start": span, "end": span, "text": "t"}]}) for s, i in (("a", 0), ("b", 1), ("a", 2))) + '\n{"span": "c", "seg')
    assert sorted((r.span, r.segments[0].id) for r in files.read_resume_log(spark, str(log)).collect()) == [("a", 2), ("b", 1)]
    (tmp_path / "h.json").write_text(json.dumps({"version": 1, "entries": [{"input": "i", "output": "o", "engine": "e", "finished_at_ms": 5}]}))
    assert files.read_history(spark, str(tmp_path / "h.json")).first().finished_at_ms == 5
    (tmp_path / "o.json").write_text(json.dumps({"version": 1, "outputs": {"k": "p"}}))
    assert tuple(files.read_ownership(spark, str(tmp_path / "o.json")).first()) == ("k", "p")


def test_catalogue(spark, tmp_path):
    def model(name, requires=(), size=3):
        return {"id": name, "display_name": name, "files": [{"remote": "r", "local": "model.onnx", "size": size}], "requires": list(requires), "mirrors": [{"name": "m", "base_url": "u", "repo": "r"}]}

    path = tmp_path / "c.json"
    path.write_text(json.dumps({"version": 1, "models": [model("a", ["v"]), model("v", size=None), model("b", ["b", "zzz"])]}))
    models, parts, mirrors = files.read_catalogue(spark, str(path))
    disk = spark.createDataFrame([("a", "model.onnx", 3), ("b", "model.onnx", 9)], "id string, local string, size long")
    assert {r.id: (r.present, r.runnable) for r in catalogue.presence(models, parts, disk).collect()} == {"a": (True, False), "v": (False, False), "b": (False, False)}
    assert sorted((r.id, r.fetch) for r in catalogue.to_fetch(models, parts, disk).collect()) == [("a", "v"), ("b", "b"), ("b", "b"), ("v", "v")]
    assert sorted((r.id, r.problem) for r in catalogue.violations(models, parts, mirrors).collect()) == [("b", "requires itself"), ("b", "requires what isn't listed")]
    assert {r.id: r.total_bytes for r in catalogue.sizes(parts).collect()} == {"a": 3, "v": None, "b": 3}
    found = files.model_folder(models, parts, spark.createDataFrame([("a", "model.onnx"), ("", "other")], "folder string, local string"))
    assert {r.id: (r.folder, r.missing) for r in found.collect()} == {"a": ("a", None), "v": (None, "model.onnx"), "b": (None, "model.onnx")}
    path.write_text(json.dumps({"version": 7, "models": [model("a")]}))
    with pytest.raises(Exception, match="version 7 is not supported"):
        files.read_catalogue(spark, str(path))[0].collect()


def test_pcm_chunks_lose_nothing_but_a_partial_sample(spark, tmp_path):
    samples = np.linspace(-1, 1, 1600 * 3 + 17, dtype="<f4")
    (tmp_path / "a.f32").write_bytes(samples.tobytes() + b"\x01\x02")
    pcm.register(spark)
    rows = spark.read.format("pcm").load(str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.start, len(r.samples)) for r in rows] == [(0, 0, 1600), (1, 1600, 1600), (2, 3200, 1600), (3, 4800, 17)]
    assert np.array_equal(np.concatenate([r.samples for r in rows]).astype("<f4"), samples)


def test_corpus_reference_columns(spark):
    rows = spark.createDataFrame([(2, (b"x",), " a\tb "), (1, (b"y",), "c"), (3, (None,), "d"), (4, (b"z",), "")], "k int, context struct<bytes: binary>, original_text string")
    assert [(r.id, r.reference) for r in files.audio_corpus(rows, "k").orderBy("id").collect()] == [("000000", "c"), ("000001", "a b")]
    with pytest.raises(ValueError, match="answer"):
        files.pick_reference(["x"])
