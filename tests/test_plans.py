"""Templates, transfers, reports, catalog, discovery, streams."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from fotoloom.config import EngineConfig, SimilarityConfig, TransferConfig
from fotoloom.plans import report, template, transfer
from fotoloom.plans.pipeline import Media
from fotoloom.sources import catalog, discovery, media
from fotoloom.streaming import gather

SCHEMA = "file_path string, image_date timestamp, created_at timestamp, gps_latitude double, gps_longitude double, camera_model string, duration double"
T = dt.datetime


def target(spark, text, path="in/IMG_1.JPG", image=T(2024, 12, 30, 0, 5, 9), created=T(2023, 7, 4, 13, 7, 8), lat=34.125, lon=1.005, cam="A:B/c", duration=0.0):
    df = spark.createDataFrame([(path, image, created, lat, lon, cam, duration)], SCHEMA)
    return df.select(template.compile_template(text, "out/")).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("{D.YYYY}/{D.MM}/{D.DD}/{NAME}{EXT}", "out/2024/12/30/IMG_1.JPG"),
        ("{D.YYYY}/{D.MM}", "out/2024/12/IMG_1.JPG"),
        ("{I.YY}{I.MMMM}{I.MMM}{I.M}{I.D}{I.DDDD}{I.DDD}", "out/24DecemberDec1230MondayMon/IMG_1.JPG"),
        ("{I.HH}{I.H}{I.hh}{I.h}{I.mm}{I.m}{I.ss}{I.s}{I.a}{I.A}", "out/000121205509" + "9amAM/IMG_1.JPG"),
        ("W{I.WW}/{F.HH}/{NAME.L}", "out/W01/13/img_1.JPG"),
        ("{NAME.U}_{TYPE}_{HAS.GEO}_{HAS.CAM}_{HAS.DATE}{EXT}", "out/IMG_1_Image_GeoTagged_WithCamera_Dated.JPG"),
        ("{GEO}/{CAM}/{NAME}", "out/34.13_1.01/A_B/c/IMG_1.JPG"),
        ("{UNKNOWN}/{NAME}", "out/{UNKNOWN}/IMG_1.JPG"),
        ("", "out/NoDate/IMG_1.JPG"),
    ],
)
def test_templates(spark, text, want):
    assert target(spark, text) == want


def test_missing_values(spark):
    gone = dict(image=None, lat=0.0, lon=5.0, cam=None, duration=3.0)
    assert target(spark, "{I.YYYY}", **gone) == "out/NoDate/IMG_1.JPG"
    assert target(spark, "{D.YYYY}/{HAS.DATE}/{HAS.GEO}/{HAS.CAM}/{TYPE}{GEO}", **gone) == "out/2023/NoDate/NoGeo/NoCamera/Video/IMG_1.JPG"
    assert len(template.KEYS) == 74
    a = target(spark, "{RND}/{NAME}")
    assert a == target(spark, "{RND}/{NAME}") != target(spark, "{RND}/{NAME}", path="other/IMG_1.JPG") and len(a.split("/")[1]) == 8


def test_conflicts(spark):
    df = spark.createDataFrame([("b/x.jpg", "t/x.jpg"), ("a/x.jpg", "t/x.jpg"), ("c/y.jpg", "t/y.jpg")], "file_path string, target string")
    got = {r.file_path: r.target for r in template.settle_conflicts(df).collect()}
    assert got["a/x.jpg"] == "t/x.jpg" and got["c/y.jpg"] == "t/y.jpg"
    assert got["b/x.jpg"].startswith("t/x_") and got["b/x.jpg"].endswith(".jpg") and len(got["b/x.jpg"]) == len("t/x_12345678.jpg")


def library(spark):
    rows = [(f"in/{n}", h, s, d) for n, h, s, d in [("a.jpg", "00000000000000ff", 1000, 0.0), ("b.jpg", "00000000000000ff", 2000, 0.0), ("c.jpg", "ffff000000000000", 10, 0.0), ("d.mp4", None, 10, 4.0), ("bad.jpg", None, 0, 0.0)]]
    df = spark.createDataFrame(rows, "file_path string, phash string, size bigint, duration double")
    df = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("gps_latitude", "double"), ("gps_longitude", "double"), ("camera_model", "string"), ("image_date", "timestamp"))])
    return df.withColumn("created_at", F.timestamp_seconds(F.lit(1600000000))).withColumn("error", F.when(F.col("file_path") == "in/bad.jpg", "HashingError: x"))


def test_run(spark):
    cfg = EngineConfig(transfer=TransferConfig("lib", "{D.YYYY}/{NAME}{EXT}", "dups", "bad"))
    done = Media(library(spark), cfg).deduplicate()
    assert done.summary().first().asDict() == {"n_files": 4, "n_unique": 2, "n_sets": 1, "n_representatives": 1, "n_duplicates": 1, "n_errors": 0}
    plan = {r.file_path: (r.target, r.reason, r.action) for r in done.plan().collect()}
    assert plan == {
        "in/a.jpg": ("dups/b/a.jpg", "duplicate", "copy"), "in/b.jpg": ("lib/2020/b.jpg", "representative", "copy"), "in/c.jpg": ("lib/2020/c.jpg", "unique", "copy"),
        "in/d.mp4": ("lib/2020/d.mp4", "unique", "copy"), "in/bad.jpg": ("bad/bad.jpg", "error", "copy"),
    }
    assert [r.error for r in done.transfer().collect()] == [None] * 5
    odd = EngineConfig(transfer=TransferConfig("lib", duplicate_dir="dups", reference_routing=True))
    assert "in/b.jpg" not in {r.file_path for r in Media(library(spark), odd).deduplicate().plan().collect()}
    placed = done.placed
    assert transfer.anything_to_do(placed, cfg.transfer)
    assert not transfer.anything_to_do(placed.where("role = 'duplicate'"), TransferConfig())
    assert not transfer.anything_to_do(placed.limit(0), cfg.transfer, Media(library(spark), cfg).files.limit(0))


def test_carrying_out(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"1")
    plan = spark.createDataFrame([(str(tmp_path / "x.jpg"), str(tmp_path / "to/x.jpg"), "unique", "move"), (str(tmp_path / "no.jpg"), str(tmp_path / "to/no.jpg"), "unique", "copy")], "file_path string, target string, reason string, action string")
    got = {os.path.basename(r.file_path): r.error for r in transfer.carry_out(plan, dry_run=False).collect()}
    assert got["x.jpg"] is None and got["no.jpg"].startswith("FileSystemError") and (tmp_path / "to/x.jpg").read_bytes() == b"1" and not (tmp_path / "x.jpg").exists()


def test_report(spark, tmp_path):
    rows = [(f"f{i:05}", f"s{i // 2:05}", "representative" if i % 2 == 0 else "duplicate", float(i % 2 == 0)) for i in range(4100)] + [("u", None, "unique", 1.0)]
    df = spark.createDataFrame(rows, "file_path string, set_id string, role string, score double")
    pages = report.report_rows(df)
    assert sorted(tuple(r) for r in report.page_totals(pages).collect()) == [(0, 1000, 1000, 1000), (1, 1000, 1000, 1000), (2, 50, 50, 50)]
    assert all(r.set_no == int(r.set_id[1:]) for r in pages.collect())
    report.write_report(pages, str(tmp_path / "r"))
    (file,) = glob.glob(str(tmp_path / "r/page=2/part-*"))
    text = open(file).read()
    assert text.startswith("<!DOCTYPE html>") and text.count("<figure") == 100 and text.index("f04000") < text.index("f04001")
    got = spark.createDataFrame([(3 << 20, 3723.5), (0, 59.0)], "b bigint, s double").select(report.size_text(F.col("b")), report.duration_text(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("3.00 MB", "1:2:3s"), ("0.00 MB", "59s")]


def test_catalog(spark):
    infos = spark.createDataFrame(
        [("a", bytearray(b"\x01"), 5, T(2020, 1, 1), T(2020, 1, 2), 4, 3, 1.0, 2.0, "M", T(2019, 1, 1), 0.0, [(bytearray.fromhex("abcdef1234567890"), 0.0), (bytearray(8), 1.0)]), ("b", None, None, None, None, None, None, None, None, None, T(1970, 1, 1), None, [])],
        "file_path string, content_hash binary, size bigint, created_at timestamp, modified_at timestamp, width int, height int, gps_latitude double, gps_longitude double, camera_model string, image_date timestamp, duration double, frames array<struct<hash:binary,timestamp:double>>",
    )
    rows = catalog.to_rows(infos)
    a, b = sorted(rows.collect(), key=lambda r: r.file_path)
    assert (a.content_hash, a.phash, a.lsh_key1, a.lsh_key4) == ("01", "abcdef1234567890", "abcd", "7890") and b.phash is None and b.lsh_key1 is None
    a, b = sorted(catalog.to_infos(rows).collect(), key=lambda r: r.file_path)
    assert len(a.frames) == 1 and bytes(a.frames[0].hash).hex() == "abcdef1234567890" and a.image_date == T(2019, 1, 1)
    assert (b.size, b.width, b.duration, b.frames, b.image_date, b.created_at) == (0, 0, 0.0, [], None, T(1970, 1, 1))
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "file_path string, v int, modified_at int")
    new = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 4, 1)], "file_path string, v int, modified_at int")
    assert sorted(tuple(r) for r in catalog.upsert(old, new).collect()) == [("a", 1, 1), ("b", 3, 3), ("c", 4, 1)]
    assert catalog.by_paths(old, new, ["file_path", "v"]).collect() == [("b", 1)] and catalog.by_path(old, "a").count() == 1
    assert catalog.by_paths(old, new.limit(0)).collect() == []


def test_discovery(spark, tmp_path):
    for name, data in (("a.jpg", b"1"), ("s/b.PNG", b"22"), ("c.txt", b"3"), ("d.MP4", b"4444"), ("s/.jpg", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = discovery.discover(spark, [str(tmp_path)])
    assert {(os.path.relpath(r.file_path, tmp_path), r.size, r.ext, r.type) for r in found.collect()} == {("a.jpg", 1, "jpg", 1), ("s/b.PNG", 2, "png", 1), ("d.MP4", 4, "mp4", 0)}
    stats = [(r.type, r.ext, r.n) for r in discovery.format_stats(found).collect()]
    assert stats == [(0, "mp4", 1), (1, "jpg", 1), (1, "png", 1), (None, None, 3)]
    hashed = discovery.file_stats(discovery.discover(spark, [str(tmp_path)], True), 10).select("content_hash").collect()
    assert len({r[0] for r in hashed}) == 3


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(pixels, side):
        raw = b"".join(b"\0" + bytes(pixels[y * side : (y + 1) * side]) for y in range(side))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    pixels = [(x * 7 + y * 13) % 256 for y in range(32) for x in range(32)]
    (tmp_path / "a.png").write_bytes(png(pixels, 32))
    from fotoloom.config import FrameConfig

    rasters = media.gray_rasters(spark, [str(tmp_path)], FrameConfig(resolution=16))
    r = media.image_hashes(rasters, 16).first()
    assert len(r.phash) == 16 and abs(r.gray[0] - (pixels[0] + pixels[1] + pixels[32] + pixels[33]) / 4) < 1e-6
    lines = spark.createDataFrame([("n:0 pts:1 pts_time:1.25 x",), ("none",)], "l string")
    assert [x[0] for x in lines.select(media.frame_time(F.col("l"))).collect()] == [1.25, None]


def test_streams(spark, tmp_path):
    src, cat = str(tmp_path / "src"), str(tmp_path / "cat")
    kind = "file_path string, v int, modified_at timestamp"
    for i, rows in enumerate(([("a", 1, T(2024, 1, 1)), ("b", 1, T(2024, 1, 1))], [("b", 2, T(2024, 1, 2)), ("c", 1, T(2024, 1, 2))])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        q = gather.gather_stream(spark.readStream.schema(kind).parquet(src), cat, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert sorted((r.file_path, r.v) for r in gather.current(spark, cat).collect()) == [("a", 1), ("b", 2), ("c", 1)]
    spark.createDataFrame([("a", bytearray(b"x"), T(2024, 1, 1)), ("b", bytearray(b"x"), T(2024, 1, 1)), ("c", bytearray(b"y"), T(2024, 1, 1))], "file_path string, content binary, modified_at timestamp").write.parquet(str(tmp_path / "f"))
    files = spark.readStream.schema("file_path string, content binary, modified_at timestamp").parquet(str(tmp_path / "f"))
    q = gather.arriving(files, 100).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").count() == 2
    counts = gather.format_counts(spark.readStream.schema(kind).parquet(src).withColumn("ext", F.lit("jpg"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 4


def jpeg(model=b"Cam\0", taken=b"2023:10:26 15:30:00\0"):
    import struct

    data = b""
    ifd = lambda entries, at: struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + b"\0\0\0\0"
    texts = 8 + 2 + 3 * 12 + 4  # after the first directory
    exif_at = texts + len(taken)
    gps_at = exif_at + 2 + 12 + 4
    rat = gps_at + 2 + 4 * 12 + 4
    first = ifd([(0x0110, 2, len(model), model.ljust(4, b"\0")), (0x8769, 4, 1, struct.pack("<I", exif_at)), (0x8825, 4, 1, struct.pack("<I", gps_at))], 8)
    exif = ifd([(0x9003, 2, len(taken), struct.pack("<I", texts))], exif_at)
    gps = ifd([(1, 2, 2, b"N\0\0\0"), (2, 5, 3, struct.pack("<I", rat)), (3, 2, 2, b"W\0\0\0"), (4, 5, 3, struct.pack("<I", rat))], gps_at)
    data = b"II*\0\x08\0\0\0" + first + taken + exif + gps + struct.pack("<6I", 40, 1, 30, 1, 0, 1)
    app1 = b"Exif\0\0" + data
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 9, 8, 480, 640) + b"\0\0" + b"\xff\xda\0\0"


def test_tags():
    from fotoloom.sources.exif import read_tags

    assert read_tags(jpeg()) == {"Model": "Cam", "DateTimeOriginal": "2023:10:26 15:30:00", "GPSLatitude": "40.5", "GPSLongitude": "-40.5", "ImageWidth": "640", "ImageHeight": "480"}
    assert read_tags(None) == read_tags(b"junk") == read_tags(b"\xff\xd8\xff") == read_tags(b"II*\0") == {}


def test_command_line(spark, tmp_path, capsys):
    from fotoloom.__main__ import main

    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    import struct
    import zlib

    def png(seed, side=32):
        raw = b"".join(b"\0" + bytes((x * seed + y * y * 13) % 256 for x in range(side)) for y in range(side))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    for name, seed in (("a.png", 7), ("b.png", 7), ("c.png", 3)):
        (src / name).write_bytes(png(seed))
    (src / "bad.png").write_bytes(b"no image")
    (src / "note.txt").write_bytes(b"x")
    cache = str(tmp_path / "cache")
    code = main([str(src), str(out), "--cache", cache, "-d", str(tmp_path / "dup"), "-e", str(tmp_path / "err"), "-r", "16", "-F", "{TYPE}/{NAME}{EXT}", "--debug", str(tmp_path / "report")])
    assert code == 0 and sorted(p.name for p in (out / "Image").iterdir()) == ["a.png", "c.png"]
    assert [p.name for p in (tmp_path / "dup/a").iterdir()] == ["b.png"] and [p.name for p in (tmp_path / "err").iterdir()] == ["bad.png"]
    assert (src / "a.png").exists() and (tmp_path / "report/page=0").is_dir()
    # a rerun reads and decodes what is new only, and comes to the same plan
    from fotoloom import __main__ as cli

    (src / "d.png").write_bytes(png(5))
    cfg = cli.config_of(cli.parser().parse_args([str(src), str(out), "-r", "16"]))
    seen = []
    read, decode = cli.read_ends, cli.media.gray_rasters
    cli.read_ends = lambda files, n: (seen.append(sorted(os.path.basename(r.file_path) for r in files.collect())), read(files, n))[1]
    cli.media.gray_rasters = lambda s, paths, f: (seen.append(sorted(map(os.path.basename, paths))), decode(s, paths, f))[1]
    try:
        again = {os.path.basename(r.file_path): (r.phash, r.error) for r in cli.gathered(spark, [str(src)], cfg, None, cache).collect()}
    finally:
        cli.read_ends, cli.media.gray_rasters = read, decode
    assert seen == [["d.png"], ["bad.png", "d.png"]]  # what can't be decoded is tried again
    plain = {os.path.basename(r.file_path): (r.phash, r.error) for r in cli.gathered(spark, [str(src)], cfg).collect()}
    assert again == plain and plain["bad.png"][1].startswith("ExternalToolError") and plain["a.png"][0] == plain["b.png"][0] is not None


def test_unreadable_files_are_errors(spark, tmp_path):
    (tmp_path / "ok.jpg").write_bytes(jpeg())
    (tmp_path / "long.jpg").write_bytes(jpeg() + bytes(range(256)) * 20)
    rows = [(str(tmp_path / n), T(2020, 1, 1)) for n in ("ok.jpg", "long.jpg", "gone.jpg")] + [(str(tmp_path), T(2020, 1, 1))]
    df = spark.createDataFrame(rows, "file_path string, modified_at timestamp")
    got = {os.path.basename(r.file_path): r for r in discovery.read_ends(df, 1000).collect()}
    assert got["gone.jpg"].error.startswith("FileSystemError") and got["gone.jpg"].content_hash is None and got[tmp_path.name].error.startswith("FileSystemError")
    assert got["ok.jpg"].error is None and got["ok.jpg"].tags["Model"] == "Cam" and got["long.jpg"].tags["Model"] == "Cam"
    whole = discovery.file_stats(discovery.discover(spark, [str(tmp_path)], True), 1000).select("file_path", "content_hash").collect()
    assert {os.path.basename(r.file_path): r.content_hash for r in whole} == {n: got[n].content_hash for n in ("ok.jpg", "long.jpg")}


def test_enrich_says_what_lacks(spark):
    files = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "FileSystemError: x")], "file_path string, error string")
    metadata = spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, width int")
    hashes = spark.createDataFrame([("a", "00"), ("c", "01")], "file_path string, phash string")
    got = {r.file_path: r.error for r in Media(files).enrich(metadata, hashes).files.collect()}
    assert got == {"a": None, "b": "HashingError: no hash", "c": "ExternalToolError: no metadata", "d": "FileSystemError: x"}


def test_files_at_the_target_stay(spark, tmp_path):
    for name, data in (("x.jpg", b"new"), ("to/x.jpg", b"old one")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    plan = spark.createDataFrame([(str(tmp_path / "x.jpg"), str(tmp_path / "to/x.jpg"), "unique", "copy")], "file_path string, target string, reason string, action string")
    (first,) = transfer.carry_out(plan, dry_run=False).collect()
    assert first.error is None and first.target != str(tmp_path / "to/x.jpg") and open(first.target, "rb").read() == b"new" and (tmp_path / "to/x.jpg").read_bytes() == b"old one"
    transfer.carry_out(plan, dry_run=False).collect()  # run again, it finds its own work done
    assert len(list((tmp_path / "to").iterdir())) == 2
    with pytest.raises(FileExistsError):
        transfer.free_target(str(tmp_path / "x.jpg"), str(tmp_path / "to/x.jpg"), 0)


def test_sets_by_full_similarity(spark):
    from fotoloom.operators.dispatch import media_sets, media_similarity

    f = lambda hs: [(float(i), h) for i, h in enumerate(hs)]
    a, b, c = 0x1111222233334444, 0x5555666677778888, 0x0F0F0F0F0F0F0F0F
    rows = [
        ("img1", a, False, 0.0, None), ("img2", a, False, 0.0, []), ("img3", a ^ 1, False, 0.0, None),
        ("vid1", a, True, 3.0, f([a, b, c])), ("vid2", a ^ 2, True, 3.0, f([a ^ 2, b, c])), ("vid3", a, True, 3.0, f([a, c, a])), ("vid4", b, True, 3.0, f([b, b, b])), ("vid5", b, True, 3.0, f([b, b, b])), ("none", None, False, 0.0, None),
    ]
    df = spark.createDataFrame(rows, "file_path string, bits long, is_video boolean, duration double, frames array<struct<ts:double,hash:bigint>>")
    df = df.withColumn("phash", F.lower(F.lpad(F.hex("bits"), 16, "0"))).withColumn("phash", F.when(F.col("bits").isNotNull(), F.col("phash")))
    pairs = spark.createDataFrame([("img1", "img3"), ("img1", "vid1"), ("vid1", "vid2"), ("vid1", "vid3")], "a string, b string")
    got = {(r.a, r.b): (r.similarity, r.threshold) for r in media_similarity(pairs, df, SimilarityConfig()).collect()}
    assert got[("img1", "img3")] == (63 / 64, 0.99) and got[("img1", "vid1")] == (1.0, 0.93) and got[("vid1", "vid2")][0] == pytest.approx(1 - 1 / 192) and got[("vid1", "vid3")][0] < 0.93
    # an image that is a frame of both ties videos together that are not alike; images of a bit's difference are not similar
    sets = {r.file_path: r.set_id for r in media_sets(df, SimilarityConfig()).collect()}
    assert sets == {n: "img1" for n in ("img1", "img2", "img3", "vid1", "vid2", "vid3")} | {"vid4": "vid4", "vid5": "vid4"}
