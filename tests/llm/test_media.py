import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import media

from .util import AWKWARD, make_docs


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (8, 64), (7, 6)):
        colour, grey = rng.integers(0, 256, (h, w, 3), np.uint8), rng.integers(0, 256, (h, w), np.uint8)
        assert (media.decode(media.encode_ppm(colour)) == colour).all()
        assert (media.decode(media.encode_bmp(colour)) == colour).all()
        assert (media.decode(media.encode_ppm(grey)) == grey).all()
        assert (media.from_npy(media.to_npy(colour)) == colour).all()
    assert (media.decode(b"P2 # a comment\n2 1\n255\n7 9") == [[7, 9]]).all()
    assert (media.decode(b"P3\n1 1\n255\n1 2 3\n") == [[[1, 2, 3]]]).all()
    assert (media.decode(b"P1\n2 2\n1 0 0 1") == [[0, 255], [255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert (media.decode(b"P5\n1 1\n65535\n\x01\x02") == [[258]]).all()


def test_area_resize_keeps_means():
    rng = np.random.default_rng(1)
    grey = rng.uniform(0, 255, (13, 17))
    small = media.area_resize(grey, 5, 4)
    assert np.isclose(small.mean(), grey.mean()) and np.allclose(media.area_resize(grey, 13, 17), grey)
    assert np.allclose(media.area_resize(np.kron(small, np.ones((3, 2))), 5, 4), small)
    assert media.area_resize(grey[:1, :1], 8, 9).shape == (8, 9)


def test_texts_survive_as_images(spark):
    texts = AWKWARD + ["Ünïcode " * 100, "one"]
    docs = make_docs(spark, texts).withColumn("tile", F.lit(1)).withColumn("image", F.lit("x"))
    for kind in ("ppm", "bmp"):
        rows = {r["doc_id"]: r for r in media.media_columns(docs, kind=kind).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            payload = raw + b" " * (-len(raw) % 192 if raw else 192)
            r = rows[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert rows[3]["feature"] == rows[len(texts) - 1]["feature"] and rows[0]["media_sha256"] == rows[1]["media_sha256"]
    assert media.media_columns(docs.where("false")).count() == 0


def test_null_images(spark):
    images = spark.createDataFrame([(1, None)], "doc_id long, image binary")
    row = media.npy_tiles(images).first()
    assert row["tile"] is None and row["dhash"] is None


def test_images_that_cannot_be_decoded(spark):
    good = media.encode_ppm(np.arange(12, dtype=np.uint8).reshape(2, 2, 3))
    broken = [b"", b"P", b"P6", b"P6\n2 2\n255\n", b"P6\n-1 2\n255\n", b"P9\n1 1\n", b"BM", good[:-3], media.encode_bmp(np.zeros((3, 3, 3), np.uint8))[:60], b"\x89PNG\r\n", b"P6\n0 0\n255\n", b"P3\n1 1\n255\nx y z", b"P5 # no end of this"]
    images = spark.createDataFrame([(i, len(b), bytearray(b), "mine") for i, b in enumerate([*broken, good])], "doc_id long, n_bytes long, image binary, dhash string")
    tiles = media.npy_tiles(images)
    rows = {r["doc_id"]: r for r in tiles.collect()}
    assert all(rows[i]["tile"] is None and rows[i]["dhash"] is None for i in range(len(broken))) and rows[len(broken)]["tile"]
    digests = {r["doc_id"]: r for r in media.tile_digests(tiles).collect()}
    assert digests[0]["payload_bytes"] is None and digests[len(broken)]["payload_bytes"] == 12
