"""Readers on small files: audio, listings, meetings, references, settings."""

import io
import json
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.sources import audio, config, files, meetings, references, transcripts


def tone(seconds=1.0, rate=16_000, hz=440.0, loud=0.5):
    return (loud * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def riff(kind, channels, rate, bits, data, extra=b""):
    head = b"WAVEfmt " + (16).to_bytes(4, "little") + b"".join(v.to_bytes(n, "little") for v, n in ((kind, 2), (channels, 2), (rate, 4), (rate * channels * bits // 8, 4), (channels * bits // 8, 2), (bits, 2)))
    return b"RIFF" + (0).to_bytes(4, "little") + head + extra + b"data" + len(data).to_bytes(4, "little") + data


def test_wav_of_every_width():
    x = tone(0.1)
    for bits, data in ((8, ((x * 127) + 128).round().astype(np.uint8).tobytes()), (16, (x * 32767).round().astype("<i2").tobytes()), (24, b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in x)), (32, (x * 2147483647).astype("<i4").tobytes())):
        got, rate = audio.decode(riff(1, 1, 16_000, bits, data, extra=b"LIST\x03\x00\x00\x00abc\x00"))
        assert rate == 16_000 and np.abs(got - x).max() < (0.02 if bits == 8 else 1e-4)
    got, _ = audio.decode(riff(3, 1, 8_000, 32, x.astype("<f4").tobytes()))
    assert np.array_equal(got, x)
    stereo = np.stack([x, np.zeros_like(x)], axis=1)
    assert np.abs(audio.decode(riff(1, 2, 8_000, 16, (stereo * 32767).round().astype("<i2").tobytes()))[0] - x / 2).max() < 1e-4
    assert np.abs(audio.decode(audio.encode(x, 16_000))[0] - x).max() < 1e-4
    for bad in (b"", b"fLaC....", b"RIFFxxxxWAVE", riff(1, 1, 8_000, 12, b"ab")):
        with pytest.raises(ValueError):
            audio.decode(bad)


def test_resample_and_denoise():
    x = tone(1.0, 48_000)
    y = audio.resample(x, 48_000, 16_000)
    assert len(y) == 16_000 and np.abs(y - tone(1.0, 16_000)).max() < 0.01
    r = np.random.default_rng(1)
    noisy = r.normal(0, 0.01, 32_000).astype(np.float32)
    noisy[8_000:16_000] += tone(0.5)
    clean = audio.light_denoise(noisy, 16_000)
    rms = lambda v: float(np.sqrt((v**2).mean()))
    assert rms(clean[20_000:]) < 0.5 * rms(noisy[20_000:]) and rms(clean[9_000:15_000]) > 0.7 * rms(noisy[9_000:15_000])
    short = tone(0.2)
    assert np.array_equal(audio.light_denoise(short, 16_000), short)


def test_audio_files(spark, tmp_path):
    quiet = np.zeros(16_000, np.float32)
    (tmp_path / "b").mkdir()
    (tmp_path / "a.WAV").write_bytes(audio.encode(np.concatenate([quiet, tone(), quiet]), 16_000))
    (tmp_path / "b/c.wav").write_bytes(audio.encode(tone(2.0, 8_000), 8_000))
    (tmp_path / "b/d.mp3").write_bytes(b"no audio")
    (tmp_path / "notes.txt").write_text("x")
    path = f"file://{tmp_path}"
    assert [r["name"] for r in files.find_audio(spark, path).collect()] == ["a.WAV", "c.wav", "d.mp3"]
    assert files.find_audio(spark, f"{path}/b/c.wav").count() == 1
    with pytest.raises(FileNotFoundError):
        files.find_audio(spark, f"{path}/none")
    with pytest.raises(FileNotFoundError):
        files.find_audio(spark, f"{path}/notes.txt")
    got = {r["file_id"].rsplit("/", 1)[-1]: r for r in audio.waveforms(audio.audio_files(spark, path), max_seconds=1.5).collect()}
    assert (len(got["a.WAV"]["samples"]), len(got["c.wav"]["samples"])) == (24_000, 24_000) and got["d.mp3"]["problem"] and got["d.mp3"]["samples"] is None
    active = [(round(r["start"], 1), round(r["end"], 1)) for r in audio.voice_activity(audio.audio_files(spark, path)).where("file_id like '%a.WAV'").collect()]
    assert active == [(1.0, 2.0)] or (len(active) == 1 and abs(active[0][0] - 1) < 0.15 and abs(active[0][1] - 2) < 0.15)
    forced = audio.voice_activity(audio.audio_files(spark, path), neural=lambda x, rate: [(0.0, len(x) / rate)])
    assert {r["end"] for r in forced.collect()} == {3.0, 2.0}
    rows = spark.createDataFrame([("x", (bytearray(audio.encode(tone(0.5), 16_000)), "p")), ("y", (None, "q"))], "file_id string, audio struct<bytes:binary,path:string>")
    assert {r["file_id"]: (r["sample_rate"], r["problem"] is None) for r in audio.embedded(rows).collect()} == {"x": (16_000, True), "y": (None, False)}


def test_listings_and_cache(spark, tmp_path):
    for k, name in enumerate(["old.json", "new.json", "manual_corrected_latest.json"]):
        (tmp_path / name).write_text(json.dumps({"file": name, "segments": [{"start": 0.0, "end": 1.0, "text": f"text {k}"}]}))
        time.sleep(0.02)
    path = f"file://{tmp_path}"
    assert [r["name"] for r in files.history(spark, path).collect()] == ["new.json", "old.json"]
    first = files.signature(spark, path)
    assert first[0] == 2 and files.signature(spark, path) == first and files.signature(spark, f"{path}/none") == (0, 0.0)
    reads = []
    cache = files.ResultCache(spark, lambda s, p: reads.append(p) or transcripts.read_results(s, p))
    assert cache.get(path).count() == cache.get(path).count() == 2 and len(reads) == 1
    (tmp_path / "third.json").write_text(json.dumps({"file": "t", "segments": [{"start": 0.0, "text": "abc"}]}))
    assert cache.get(path).count() == 3 and len(reads) == 2
    corpus = transcripts.corpus_segments(cache.get(path), "d")
    assert sorted(r["uid"] for r in corpus.collect()) == ["d/new.json#0", "d/old.json#0"]
    transcripts.write_corrected(cache.get(path), f"{path}/out/manual_corrected_latest.json")
    saved = spark.read.json(f"{path}/out/manual_corrected_latest.json").first()
    assert [f["file"] for f in saved["files"]] == ["new.json", "old.json", "t"]


def test_datasets_and_archives(spark, tmp_path):
    for name in ("s2", "s1"):
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as tar:
            for k in (2, 1):
                data = f"{name}{k}".encode()
                info = tarfile.TarInfo(f"train/{name}/U{name}{k}.wav")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (tmp_path / "bad.tar.gz").write_bytes(b"broken")
    (tmp_path / "z.flac").write_bytes(b"fLaC")
    path = f"file://{tmp_path}"
    members = files.tar_members(spark, path)
    assert members.count() == 4
    known = spark.createDataFrame([("Us12",), ("Us21",), ("Us22",)], "utt_id string")
    chosen = sorted((r["utt_id"], bytes(r["content"])) for r in files.corpus_subset(members, known, 2).collect())
    assert chosen == [("Us12", b"s12"), ("Us21", b"s21")]
    assert files.corpus_subset(members, None, 3).count() == 3
    assert [r["name"] for r in files.dataset_files(spark, path, "librispeech", 5).collect()] == ["z.flac"]
    with pytest.raises(ValueError):
        files.dataset_files(spark, path, "other", 5)


def test_meetings(spark, tmp_path):
    rows = []
    for k in range(10):
        clip = audio.encode(np.full(1_600, 0.6, np.float32), 16_000)
        rows.append(("m1", (bytearray(clip), "p"), 100.0 + 0.05 * k, 100.1 + 0.05 * k, "h0", f"s{k % 2}", f"t{k}"))
    rows += [("m2", (bytearray(clip), "p"), 1.0, 2.0, "h0", "s", "alone")]
    schema = "meeting_id string, audio struct<bytes:binary,path:string>, begin_time double, end_time double, microphone_id string, speaker_id string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/deep/meetings")
    path = f"file://{tmp_path}"
    read = meetings.read_meetings(spark, path)
    line = meetings.timeline(read, 0.3, least=4).orderBy("utt_idx").collect()
    assert [(r["start"], r["end"]) for r in line[:2]] == [(0.0, 0.1), (0.05, 0.15)] and len(line) == 6 and line[-1]["end"] == 0.3
    assert meetings.timeline(read).count() == 10 and meetings.timeline(read, 0.3).count() == 0
    got = meetings.overlay(read, 0.3, least=4).collect()
    assert [r["name"] for r in got] == ["m1_h0_0s"]
    samples, rate = audio.decode(bytes(got[0]["wav"]))
    assert rate == 16_000 and len(samples) == 4_800 and abs(samples.max() - 0.98) < 1e-3 and abs(samples[100] - 0.49) < 1e-3
    said = json.loads(got[0]["reference"])
    assert [(u["start"], u["end"], u["speaker"]) for u in said] == [(r["start"], r["end"], r["speaker"]) for r in line]
    with pytest.raises(FileNotFoundError):
        files.find_parquet(spark, f"{path}/none")
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError):
        files.find_parquet(spark, f"{path}/x.csv")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.find_parquet(spark, f"{path}/empty")
    spark.range(3).write.parquet(f"{path}/other")
    with pytest.raises(ValueError, match="missing columns"):
        meetings.read_meetings(spark, f"{path}/other")
    mixed = read.unionByName(read.limit(1).withColumn("audio", F.lit(None).cast("struct<bytes:binary,path:string>")))
    with pytest.raises(Exception, match="without audio"):
        meetings.overlay(mixed).collect()


LONG = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 4\ntiers? <exists>\nsize = 2\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "S1"\n        xmin = 0\n        xmax = 4\n        intervals: size = 2\n        intervals [1]:\n            xmin = 0\n            xmax = 1.5\n            text = "say ""hi"""\n        intervals [2]:\n            xmin = 1.5\n            xmax = 4\n            text = "<sil>"\n    item [2]:\n        class = "IntervalTier"\n        name = "S2"\n        xmin = 0\n        xmax = 4\n        intervals: size = 1\n        intervals [1]:\n            xmin = 2\n            xmax = 3.5\n            text = "你好"\n'
SHORT = '"ooTextFile"\n"TextGrid"\n0\n4\n<exists>\n1\n"IntervalTier"\n"S1"\n0\n4\n2\n0\n1\n"one"\n1\n4\n""\n'


def test_references(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text(LONG)
    (tmp_path / "b.TextGrid").write_text(SHORT)
    path = f"file://{tmp_path}"
    got = sorted(tuple(r) for r in references.read_textgrid_references(spark, path, duration=3.0).collect())
    assert got == [("a", 0.0, 1.5, "S1", 'say "hi"'), ("a", 2.0, 3.0, "S2", "你好"), ("b", 0.0, 1.0, "S1", "one")]
    assert {r["speaker"] for r in references.read_textgrid_references(spark, path, speaker="SPK9").collect()} == {"SPK9"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.wav.json").write_text(json.dumps({"segments": [{"start": 1.0, "end": 2.0, "text": " Hi! ", "speaker": "A"}, {"start": 2.0, "end": 9.0, "text": "late words"}, {"start": 5.0, "text": "no end"}, {"start": 0.0, "end": 1.0, "text": "..."}]}))
    (tmp_path / "j/y.json").write_text(json.dumps([{"start": 0.5, "end": 0.7, "text": "bare"}]))
    (tmp_path / "j/z.json").write_text("{broken")
    rows = sorted(tuple(r) for r in references.read_reference_json(spark, f"{path}/j", duration=4.0).collect())
    assert rows == [("x.wav.json", 1.0, 2.0, "A", "Hi!"), ("x.wav.json", 2.0, 4.0, "REF", "late words"), ("y.json", 0.5, 0.7, "REF", "bare")]
    (tmp_path / "r.rttm").write_text("SPEAKER f1 1 0.50 1.25 <NA> <NA> spk0 <NA> <NA>\n;; comment\n")
    assert [tuple(r) for r in references.read_rttm(spark, path).collect()] == [("f1", 0.5, 1.75, "spk0")]
    names = spark.createDataFrame([("R8007_M8011_MS806.wav.json",), ("R1_N_SPK8002.FLAC.json",), ("solo.json",)], "file_id string")
    one = {r["file_id"]: (r["c"], r["s"]) for r in names.select("file_id", references.reference_candidates(F.col("file_id"), True).alias("c"), references.speaker_from_name(F.col("file_id")).alias("s")).collect()}
    assert one == {"R8007_M8011_MS806.wav.json": (["R8007_M8011_MS806", "R8007_M8011"], None), "R1_N_SPK8002.FLAC.json": (["R1_N_SPK8002", "R1_N"], "SPK8002"), "solo.json": (["solo"], None)}
    there = spark.createDataFrame([("R8007_M8011",), ("solo",)], "file_id string")
    assert {r["file_id"]: r["ref_id"] for r in references.with_references(names, there, True).collect()} == {"R8007_M8011_MS806.wav.json": "R8007_M8011", "solo.json": "solo", "R1_N_SPK8002.FLAC.json": None}


def test_plain_references_and_template(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1/1-2.trans.txt").write_text("U1 THE WORDS HERE\nU2 MORE\nU3\n\n")
    (tmp_path / "other.txt").write_text("U9 not read\n")
    plain = references.read_transcripts(spark, f"file://{tmp_path}", "*.trans.txt")
    assert sorted(tuple(r) for r in plain.collect()) == [("U1", "THE WORDS HERE"), ("U2", "MORE")]
    hyp = spark.createDataFrame([("U1.flac.json", 0, 0.0, 3.5, "the words"), ("U1.flac.json", 1, 3.5, 5.0, "x"), ("U2.json", 0, 0.0, 0.0, "y"), ("U7.json", 0, 0.0, 1.0, "z")], "file_id string, seg_idx int, start double, `end` double, text string")
    assert sorted(tuple(r) for r in references.plain_references(hyp, plain, "en").collect()) == [("U1.flac.json", 0.0, 5.0, "REF", "THE WORDS HERE"), ("U2.json", 0.0, 0.01, "REF", "MORE")]
    assert references.plain_references(hyp, plain, "en", duration=2.0).agg({"end": "max"}).first()[0] == 2.0
    seg = hyp.withColumn("speaker", F.lit(None).cast("string")).withColumn("text_before_llm", F.when(F.col("seg_idx") == 1, "before"))
    made = {r["file_id"]: json.loads(r["template"]) for r in references.reference_template(seg).collect()}
    assert [s["text"] for s in made["U1.flac.json"]["segments"]] == ["the words", "before"] and made["U1.flac.json"]["segments"][0]["speaker"] == "REF"


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "configs").mkdir()
    path = tmp_path / "configs/models.json"
    path.write_text(json.dumps({"profile": "local", "device": "cpu", "llm": {"enabled": True}, "local": {"asr": {"model": "./models/a", "beam": 5}}, "cloud": {"asr": {"model": "org/a"}}}))
    got = config.model_config(str(path))
    assert got["asr"] == {"model": str(tmp_path / "models/a"), "beam": 5} and got["device"] == "cpu" and got["llm"] == {"enabled": True} and got["hf_cache"].endswith("cache/huggingface")
    assert config.model_config(str(path), "cloud")["asr"]["model"] == "org/a" and config.load_config(str(path)) is config.load_config(str(path))
    env = tmp_path / ".env"
    env.write_text("# comment\nA_KEY='one two'\nexport B_KEY=three\n\nbroken\n")
    monkeypatch.setenv("B_KEY", "own")
    assert [config.get_env(k, "none", str(env)) for k in ("A_KEY", "B_KEY", "C_KEY")] == ["one two", "own", "none"]


def test_textgrids_by_line(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text(LONG)
    got = sorted(tuple(r) for r in transcripts.read_textgrids(spark, f"file://{tmp_path}").collect())
    assert [(f, s, e) for f, _, s, e, _ in got] == [("a.TextGrid", 0.0, 1.5), ("a.TextGrid", 1.5, 4.0), ("a.TextGrid", 2.0, 3.5)]


def test_saved_results(spark, tmp_path):
    path = f"file://{tmp_path}"
    result = {"file": "a b.wav", "num_speakers": 1, "timing": {"asr": 1.5}, "meeting_summary": {"topic": "t", "key_points": ["k"]}, "segments": [{"start": 0.0, "end": 1.0, "text": "one two", "boundary_prefix_source": {"window_start": 0.5, "text": "x"}}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"files": [result]}))
    read = transcripts.read_results(spark, f"{path}/in")
    transcripts.write_results_json(read, f"{path}/out")
    transcripts.write_results_json(read.withColumn("num_speakers", F.lit(2)), f"{path}/out")
    again = transcripts.read_results(spark, f"{path}/out").collect()
    assert len(again) == 1 and again[0]["num_speakers"] == 2 and again[0]["meeting_summary"]["topic"] == "t" and again[0]["segments"][0]["boundary_prefix_source"]["text"] == "x"


def test_batches(spark, tmp_path):
    from parlance.operators import batch

    path = f"file://{tmp_path}/state"
    files = spark.createDataFrame([(f"f{k}",) for k in range(5)], "file_id string")
    none = spark.createDataFrame([], batch.STATE)
    outputs = spark.createDataFrame([("f1",)], "file_id string")
    first = batch.next_batch(files, none, outputs, "d", 2)
    assert [r["file_id"] for r in first.orderBy("file_id").collect()] == ["f0", "f2"]
    written = []
    process = lambda b: b.withColumn("problem", F.when(F.col("file_id") == "f2", "bad"))
    batch.run_batch(spark, first, "d", process, lambda done: written.extend(r["file_id"] for r in done.collect()), path)
    state = spark.read.parquet(path)
    assert written == ["f0"] and {(r["file_id"], r["failed"], r["error"]) for r in state.collect()} == {("f0", False, None), ("f2", True, "bad")}
    assert [r["file_id"] for r in batch.next_batch(files, state, outputs, "d", 9).orderBy("file_id").collect()] == ["f2", "f3", "f4"]

    def broken(b):
        raise RuntimeError("no model")

    batch.run_batch(spark, files.where("file_id = 'f3'"), "d", broken, lambda done: None, path)
    assert ("f3", True, "no model") in {(r["file_id"], r["failed"], r["error"]) for r in spark.read.parquet(path).collect()}
