"""Scalar functions against literal vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotoloom.config import SimilarityConfig
from fotoloom.functions import bits, metadata, paths, phash, similarity


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_paths(spark):
    cases = {"x/a.b.JPG": ("a.b.JPG", "JPG", "a.b", "x"), "x/.jpg": (".jpg", "", ".jpg", "x"), "a": ("a", "", "a", "."), "/a.mp4": ("a.mp4", "mp4", "a", "/"), "x.y/z": ("z", "", "z", "x.y"), "d/a.": ("a.", "", "a", "d")}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    p = F.col("p")
    for r in df.select("p", paths.basename(p), paths.extension(p), paths.stem(p), paths.dirname(p)).collect():
        assert tuple(r)[1:] == cases[r.p]


def test_types(spark):
    want = {"a.jpg": 1, "a.PNG": 1, "a.gif": 0, "a.MP4": 0, "a.mkv": None, "a": None, "a.m2ts": 0}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.t for r in df.select("p", paths.file_type(F.col("p")).alias("t")).collect()} == want
    assert len(paths.IMAGE_EXTENSIONS) == 37 and len(paths.VIDEO_EXTENSIONS) == 23
    assert one(spark, paths.normalize(F.lit("a//b\\c/./d/")), paths.normalize(F.lit("/"))) == ("a/b/c/d", "/")


@pytest.mark.parametrize("a,b,d", [("ff00ff00ff00ff00", "00ff00ff00ff00ff", 64), ("ffffffffffffffff", "fffffffffffffffe", 1), ("0000000000000000", "8000000000000001", 2), ("aabbccddeeff0011", "aabbccddeeff0012", 2), ("abcdef1234567890", "abcdef1234567891", 1)])
def test_hamming(spark, a, b, d):
    x, y = F.lit(a), F.lit(b)
    assert one(spark, bits.hamming(bits.hex_to_long(x), bits.hex_to_long(y)), bits.hamming_binary(F.unhex(x), F.unhex(y))) == (d, d)


def test_hamming_of_other_lengths(spark):
    r = random.Random(0)
    for _ in range(12):
        x, y = (bytes(r.randrange(256) for _ in range(r.randrange(20))) for _ in "ab")
        n = max(len(x), len(y))
        want = (int.from_bytes(x.ljust(n, b"\0")) ^ int.from_bytes(y.ljust(n, b"\0"))).bit_count()
        assert one(spark, bits.hamming_binary(F.lit(bytearray(x)), F.lit(bytearray(y)))) == (want,)


def test_popcount_and_hex(spark):
    assert one(spark, *[bits.popcount(F.lit(v)) for v in (0, 0xFF, 0b10101010, -1)]) == (0, 8, 4, 64)
    assert one(spark, bits.to_hex(bits.from_hex(F.lit("deadBEEF"))), bits.from_hex(F.lit("abc")), bits.from_hex(F.lit("zz")), bits.to_hex(bits.from_hex(F.lit("")))) == ("deadbeef", None, None, "")


def test_image_similarity(spark):
    b = lambda h: F.unhex(F.lit(h)) if h is not None else F.lit(None).cast("binary")
    for x, y, s in [("ffffffff", "fffffffe", 1 - 1 / 32), ("aaaaaaaa", "00000000", 0.5), ("f0f0f0f0", "0f0f0f0f", 0.0), (None, "ff", 0.0), ("", "", 1.0)]:
        assert one(spark, similarity.image_similarity_binary(b(x), b(y))) == (s,)


A, B, C, D, A2 = 0xAAAAAAAA, 0xBBBBBBBB, 0xCCCCCCCC, 0xDDDDDDDD, 0xAAAAAAAB


@pytest.mark.parametrize("other,want", [([A, B, C], 1), ([D, D, D], 0.5), ([A, D, C], 0.833333), ([A, B], 0.75), ([A, B, C, D], 0.9375), ([A2, B, C], 0.989583), ([A, None, C], 0.666667), ([], 0)])
def test_dtw(spark, other, want):
    df = spark.createDataFrame([([A, B, C], other)], "a array<bigint>, b array<bigint>")
    assert abs(df.select(similarity.dtw_similarity(F.col("a"), F.col("b"), 32)).first()[0] - want) < 1e-6
    empty = spark.createDataFrame([([], [])], "a array<bigint>, b array<bigint>")
    assert empty.select(similarity.dtw_similarity(F.col("a"), F.col("b"), 32)).first()[0] == 1


def test_thresholds():
    cfg = SimilarityConfig()
    assert [cfg.max_distance(t) for t in (0.99, 0.98, 0.95, 0.93, 1.0)] == [0, 1, 3, 4, 0]


def test_dct(spark):
    ones = np.ones(16)
    basis = phash.dct_basis(4, 2)
    assert np.allclose((basis @ ones.reshape(4, 4) @ basis.T).ravel(), [4, 0, 0, 0])
    board = np.indices((4, 4)).sum(axis=0) % 2 * 255.0
    full = phash.dct_basis(4, 4)
    assert abs((full @ board @ full.T)[0, 0] - 510) < 1e-9 and abs((full @ board @ full.T)[3, 3]) > 1
    raster = [float(v) for v in np.random.default_rng(0).integers(0, 256, 256)]
    df = spark.createDataFrame([(raster,), (None,), ([1.0],)], "g array<double>")
    got = [r[0] for r in df.select(phash.dct_udf(16)(F.col("g"))).collect()]
    b = phash.dct_basis(16)
    assert np.allclose(got[0], (b @ np.asarray(raster).reshape(16, 16) @ b.T).ravel()) and got[1] is None and got[2] is None
    small = spark.createDataFrame([(raster[:16],)], "g array<double>")
    b = phash.dct_basis(4, 2)
    assert np.allclose(small.select(phash.dct_native(F.col("g"), 4, 2)).first()[0], (b @ np.asarray(raster[:16]).reshape(4, 4) @ b.T).ravel())


def test_hash_bits(spark):
    df = spark.createDataFrame([([100.0] + [float(i) for i in range(1, 64)],), ([1.0],), ([],)], "d array<double>")
    assert [r[0] for r in df.select(phash.hash_hex(F.col("d"))).collect()] == ["01000000feffffff", None, None]
    keys = [r[0] for r in spark.createDataFrame([("abcdef1234567890",), ("abcd",), (None,)], "p string").select(phash.lsh_keys(F.col("p"))).collect()]
    assert keys == [["abcd", "ef12", "3456", "7890"], None, None]
    a = spark.createDataFrame([([5.0, 1.0, 3.0, 3.0],)], "a array<double>").select(*[phash.kth_smallest(F.col("a"), k) for k in (0, 2, 3, 9)]).first()
    assert tuple(a) == (1.0, 3.0, 5.0, None)


def test_exif(spark):
    tags = [
        ({"DateTimeOriginal": "2023:10:26 15:30:00", "ImageWidth": "1920", "ImageHeight": "1080", "GPSLatitude": "40.7128", "GPSLongitude": "-74.006", "Model": "TestCamera"}, (1920, 1080, 40.7128, -74.006, "TestCamera", "2023-10-26 15:30:00")),
        ({"CreateDate": "2020:01:02 03:04:05", "MediaCreateDate": "2019:01:01 00:00:00", "ImageWidth": "0", "ExifImageWidth": "7"}, (7, 0, None, None, None, "2020-01-02 03:04:05")),
        ({"DateTimeOriginal": "garbage", "MediaCreateDate": "2019-01-01 00:00:00"}, (0, 0, None, None, None, "2019-01-01 00:00:00")),
        ({}, (0, 0, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tags)], "i int, t map<string,string>")
    for r in df.select("i", metadata.exif_metadata(F.col("t")).alias("m")).select("i", "m.*").collect():
        assert (r.width, r.height, r.gps_latitude, r.gps_longitude, r.camera_model, r.image_date and str(r.image_date)) == tags[r.i][1]


def test_partial_md5(spark):
    import hashlib

    data = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    got = df.select(*[metadata.partial_md5(F.col("c"), m) for m in (10_000, 768, 767, 101, 1)]).first()
    want = [data, data, data[:383] + data[-383:], data[:50] + data[-50:], data[:1] + data[-1:]]
    assert list(got) == [hashlib.md5(x).hexdigest() for x in want]


SCORES = [
    ((1 << 20, 1920, 1080, None, None, None, None, 0.0), 1509.314723),
    ((1 << 20, 1920, 1080, None, None, None, None, 10.0), 11749.104250),
    ((1 << 20, 1920, 1080, 1.5, 2.5, "Cam", "2020-01-01", 0.0), 4009.314723),
    ((0, 1920, 1080, None, None, None, None, 0.0), 1440.0),
    ((1 << 20, 0, 0, None, None, None, None, 0.0), 69.314723),
    ((1 << 20, 0, 0, 0.0, 5.0, "", None, None), 69.314723),
]


def test_score(spark):
    from fotoloom.schema import SCORED

    df = spark.createDataFrame([s for s, _ in SCORES], SCORED.replace("image_date timestamp", "image_date string")).withColumn("image_date", F.col("image_date").cast("timestamp"))
    for (_, want), r in zip(SCORES, df.select(metadata.score().alias("s")).collect()):
        assert math.isclose(r.s, want, abs_tol=1e-5)


def test_sql_functions(spark):
    from fotoloom.functions.sql import register

    assert "hamming" in register(spark)
    row = spark.sql(
        "SELECT hamming(phash_bits('ffffffffffffffff'), phash_bits('fffffffffffffffe')), image_similarity(0, NULL), lsh_keys('abcdef1234567890'), lsh_keys('ab'), file_extension('x/a.JPG'), "
        "file_stem('x/.jpg'), file_stem('x/a.b.c'), media_type('a.PNG'), media_type('a.gif'), media_type('a.mkv'), CAST(exif_date('2023:10:26 15:30:00') AS STRING), kth_smallest(array(3D, 1D, 2D), 1), kth_smallest(array(1D), 4)"
    ).first()
    assert tuple(row) == (1, 0.0, ["abcd", "ef12", "3456", "7890"], None, "JPG", ".jpg", "a.b", 1, 0, None, "2023-10-26 15:30:00", 2.0, None)
