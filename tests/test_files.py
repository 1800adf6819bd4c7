"""Files that are read and written: JPEG, what files say of themselves, undecodable ones, and sinks that fail half-way."""

import io
import os
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Observation

from pixelframe.functions import kernels, payloads
from pixelframe.functions.jpeg import Code, code_lengths, jpeg, quantisers
from pixelframe.plans import jobs
from pixelframe.sources import images, sinks


def leaf(h=40, w=56):
    """Smooth colours, an edge and some noise, as a photograph has them."""
    y, x = np.indices((h, w))
    noise = np.random.default_rng(h * w).normal(0, 4, (h, w, 3))
    image = np.stack([40 + x, 90 + 2 * y, 30 + (x + y) // 2], -1) + np.where((x > w // 2)[..., None], 40, 0) + noise
    return np.clip(image, 0, 255).astype(np.uint8)


def read_back(spark, folder, **options):
    rows = images.scan_images(spark, str(folder), (".jpg", ".png", ".bmp"), strict=True, **options).collect()
    return {r.name: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in rows}


def allowed(quality):
    """The mean error that quantisation may make: values fall anywhere between two steps, so their errors spread as step / sqrt(12),
    of brightness in all three bytes, of colours by up to 1.772; and a byte is rounded twice."""
    spread = [np.sqrt((table.astype(float) ** 2).mean() / 12) for table in quantisers(quality)]
    return spread[0] + 1.772 * spread[1] + 1


def test_jpeg_files_are_decoded_close_to_their_source(spark, tmp_path):
    shapes = {"a": (40, 56), "b": (1, 1), "c": (7, 129), "d": (64, 8), "e": (17, 33)}
    kinds = [(95, False), (100, False), (50, False), (95, True)]
    smooth = lambda h, w: (np.indices((h, w)).sum(0)[..., None] * [1, 0.5, 0.8] + [9, 80, 60]).astype(np.uint8)
    picture = lambda shape, halved: smooth(*shape) if halved else leaf(*shape)
    for name, shape in shapes.items():
        for k, (quality, halved) in enumerate(kinds):
            (tmp_path / f"{name}{k}.jpg").write_bytes(jpeg(picture(shape, halved), quality, halved))
    for name, flat in {"black": 0, "white": 255, "grey": 128}.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg(np.full((20, 30, 3), flat, np.uint8)))
    found = read_back(spark, tmp_path)
    for name, shape in shapes.items():
        for k, (quality, halved) in enumerate(kinds):
            error = np.abs(found[f"{name}{k}.jpg"].astype(int) - picture(shape, halved))
            assert found[f"{name}{k}.jpg"].shape == (*shape, 3) and error.mean() <= allowed(quality), (name, k, error.mean())
    assert allowed(100) < 2 and allowed(95) < 8
    for name, flat in {"black": 0, "white": 255, "grey": 128}.items():
        assert (np.abs(found[f"{name}.jpg"].astype(int) - flat) <= 1).all()
    assert len(jpeg(leaf(), 30)) < len(jpeg(leaf(), 95)) / 2
    for wrong in (0, 101):
        with pytest.raises(ValueError, match="quality"):
            quantisers(wrong)
    with pytest.raises(ValueError, match="rows"):
        jpeg(np.zeros((0, 4, 3), np.uint8))


def test_codes_are_the_best_within_sixteen_bits():
    import heapq

    random = np.random.default_rng(1)
    for n in (1, 2, 3, 20, 256):
        counts = random.integers(1, 1000, n)
        heap, cost = sorted(counts.tolist()), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert int((code_lengths(counts) * counts).sum()) == (cost if n > 1 else int(counts[0]))
    steep = code_lengths(2 ** np.arange(25))
    assert steep.max() == 16 and sum(2.0**-k for k in steep) == 1
    code = Code(np.repeat(np.arange(25), 2 ** np.arange(25) // 4 + 1))
    bits = sorted(f"{c:0{k}b}" for c, k in zip(code.code, code.length, strict=True) if k)
    assert len(bits) == 25 and not any(b.startswith(a) for a, b in zip(bits, bits[1:], strict=False)) and not any(set(b) == {"1"} for b in bits)


def exif(orientation, order="<"):
    """A JPEG part that says how the image is turned, among other tags."""
    entry = lambda tag, kind, value: struct.pack(order + "HHIHH", tag, kind, 1, value, 0)
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, 2) + entry(256, 3, 9) + entry(274, 3, orientation) + b"\0\0\0\0"
    return b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


def test_eight_turns_come_out_alike(spark, tmp_path):
    """Each file holds what a camera held that way would have seen."""
    image = np.repeat(np.repeat(np.random.default_rng(2).integers(0, 256, (2, 3, 3)).astype(np.uint8), 8, 0), 8, 1)
    held = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.swapaxes(0, 1), 6: np.rot90(image), 7: image[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(image, -1)}
    for k, way in held.items():
        for order in "<>":
            data = jpeg(np.ascontiguousarray(way), 100)
            (tmp_path / f"{k}{ord(order)}.jpg").write_bytes(data[:2] + exif(k, order) + data[2:])
    (tmp_path / "plain.png").write_bytes(kernels.png(image))
    (tmp_path / "odd.jpg").write_bytes(jpeg(image, 100)[:2] + b"\xff\xe1\x00\x0aExif\0\0II" + jpeg(image, 100)[2:])
    found = read_back(spark, tmp_path)
    assert len(found) == 18 and all(np.abs(got.astype(int) - image).max() <= 3 for got in found.values())
    assert read_back(spark, tmp_path, turn=False)["660.jpg"].shape == (24, 16, 3)
    told = {r.name: (r.kind, r.width, r.height, r.orientation, r.reason) for r in images.catalogue(spark, str(tmp_path)).collect()}
    assert told["662.jpg"] == ("jpeg", 16, 24, 6, None) and told["odd.jpg"] == ("jpeg", 24, 16, 1, None) and told["plain.png"] == ("png", 24, 16, 1, None)


def test_files_cut_anywhere_are_told(spark):
    for encode in (kernels.png, kernels.bmp, jpeg):
        data = encode(leaf(9, 11))
        assert payloads.probe(data)[1:] == (11, 9, 1, None)
        assert all(payloads.probe(data[:k]).reason for k in range(len(data) - 1))
    assert payloads.probe(None).reason == payloads.probe(b"").reason == "empty" and payloads.probe(b"GIF89a\1\0\2\0;")[:3] == ("gif", 1, 2)
    assert payloads.probe(b"GIF89a\1").reason == "cut short" and payloads.probe(b"\xff\xd8\xff\xd9").reason == "damaged"


@pytest.fixture
def unequal(tmp_path):
    """Classes of 3 and 5 files; the first of the small one is broken."""
    for name, n in (("a", 2), ("b", 5)):
        (tmp_path / "in" / name).mkdir(parents=True)
        for i in range(n):
            image = leaf(16, 16)
            image[0, i] = 0
            (tmp_path / "in" / name / f"{name}{i}.jpg").write_bytes(jpeg(image))
    (tmp_path / "in/a/Aa.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    return tmp_path


@pytest.mark.parametrize("copy_raw", [False, True])
@pytest.mark.parametrize("mode", ["one", "class", "classes"])
def test_broken_files_fail_or_are_left_out(spark, unequal, mode, copy_raw):
    at, options = {"one": ("in/a/Aa.png", {"n": 2}), "class": ("in/a", {"target": 5}), "classes": ("in", {})}[mode]
    job = lambda out, **more: jobs.augment(spark, str(unequal / at), str(unequal / out), copy_raw=copy_raw, **options, **more).collect()
    with pytest.raises(Exception, match="cannot decode a/Aa.png"):
        job("out")
    assert not any(p.is_file() for p in (unequal / "out").rglob("*"))  # nothing half done
    written = job("left", skip=True, rejects=str(unequal / "rejects"))
    bad = spark.read.parquet(str(unequal / "rejects")).collect()
    assert [(r["class"], r.name, r.reason) for r in bad] == [("a", "Aa.png", "cut short")]
    raws = {"one": 0, "class": 2, "classes": 7}[mode] * copy_raw
    assert len(written) == {"one": 0, "class": 3, "classes": 3}[mode] + raws
    files = [p for p in (unequal / "left").rglob("*") if p.is_file()]
    assert len(files) == len(written) and all(p.suffix == ".jpg" for p in files) and not any(p.name == "Aa.png" for p in files)


def test_copies_keep_their_suffix_and_raw_ones_their_stamp(spark, unequal):
    source = unequal / "in/b/b0.jpg"
    os.utime(source, (1_000_000_000.5, 1_234_567_890.25))
    os.chmod(source, 0o640)
    jobs.augment(spark, str(source), str(unequal / "out"), n=2, copy_raw=True, methods="flip", quality=100).collect()
    found = read_back(spark, unequal / "out")
    assert sorted(found) == ["b0.jpg", "b0_Flip_0.jpg", "b0_Flip_1.jpg"]
    assert np.abs(found["b0_Flip_0.jpg"].astype(int) - found["b0.jpg"][:, ::-1]).max() <= 4
    copy = (unequal / "out/b0.jpg").stat()
    assert (unequal / "out/b0.jpg").read_bytes() == source.read_bytes() and copy.st_mtime == 1_234_567_890.25 and copy.st_mode & 0o777 == 0o640


def test_transform_tells_what_it_left_out(spark, unequal):
    seen = Observation()
    written = jobs.transform(spark, str(unequal / "in"), ("blur", "histogram"), str(unequal / "out"), rejects=str(unequal / "rejects"), seen=seen).collect()
    assert seen.get == {"read": 8, "rejected": 1} and len(written) == 14
    assert [(r.name, r.reason) for r in spark.read.parquet(str(unequal / "rejects")).collect()] == [("Aa.png", "cut short")]
    assert sorted(p.name for p in (unequal / "out/histogram/a").iterdir()) == ["a0_histogram.png", "a1_histogram.png"]
    (unequal / "in/a/a1.png").write_bytes(kernels.png(leaf()))
    with pytest.raises(ValueError, match="two outputs at histogram/a/a1_histogram.png"):
        jobs.transform(spark, str(unequal / "in"), ("histogram",), str(unequal / "out2"))


def rows_of(spark, n, parts):
    data = leaf(8, 8).tobytes()
    return spark.createDataFrame([(f"c{k % 3}/x{k}.png", 8, 8, bytearray(data)) for k in range(n)], "output string, height int, width int, data binary").repartition(parts)


def test_a_task_that_fails_half_way_leaves_no_file(spark, tmp_path):
    bad = rows_of(spark, 40, 4).selectExpr("CASE WHEN output = 'c0/x39.png' THEN 'c0/x39.webp' ELSE output END AS output", "height", "width", "data")
    with pytest.raises(Exception, match="webp"):
        sinks.write_files(bad, str(tmp_path / "out"))
    assert not any(p.is_file() for p in (tmp_path / "out").rglob("*"))
    assert sinks.write_files(rows_of(spark, 40, 4), str(tmp_path / "out")).count() == 40
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 40 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_moves_go_on_where_they_were_broken_off(spark, tmp_path):
    """Two attempts of a task, of which one counts; a driver lost after some moves."""
    import pyarrow as pa

    options = {"root": str(tmp_path / "out"), "attempts": str(tmp_path / "out/_attempts-1"), "place": "output"}
    batch = pa.RecordBatch.from_pylist([{"output": f"c/x{k}.png", "height": 8, "width": 8, "data": leaf(8, 8).tobytes()} for k in range(5)])
    writer = sinks.FileWriter(options)
    writer.write(iter([batch]))
    message = writer.write(iter([batch]))
    writer.commit([message, None])
    (tmp_path / "out/c").mkdir()
    os.rename(Path(message.listed).parent / "0", tmp_path / "out/c/x0.png")
    assert sinks.resume(spark, options["root"], options["attempts"]).count() == 5
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == [f"c/x{k}.png" for k in range(5)]


_RETRY = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
from pixelframe.sources import sinks
once = {once!r}
def rows(batches):
    import os
    for batch in batches:
        yield batch
    if not os.path.exists(once):  # the first attempt of a task is lost after its files are written
        open(once, "w").close()
        raise RuntimeError("lost")
made = spark.range(20).selectExpr("concat('x', id, '.bmp') AS output", "2 AS height", "2 AS width", "unhex(repeat('0A', 12)) AS data").repartition(2)
found = sinks.write_files(made.mapInArrow(rows, made.schema), {out!r}).collect()
assert len(found) == 20, found
"""


def test_a_retried_task_leaves_each_file_once(tmp_path):
    code = _RETRY.format(repo=str(Path(__file__).resolve().parent.parent), once=str(tmp_path / "once"), out=str(tmp_path / "out"))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=Path(__file__).resolve().parent.parent)
    assert run.returncode == 0, run.stderr[-2000:]
    assert (tmp_path / "once").exists() and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"x{k}.bmp" for k in range(20))


def test_bytes_of_a_png_in_parts():
    """A small file that grows very large is expanded part by part."""
    assert payloads.probe(kernels.png(np.zeros((2000, 3000, 3), np.uint8)))[:3] == ("png", 3000, 2000)
    assert io.BytesIO(kernels.png(np.zeros((5, 5, 3), np.uint8))).read(4) == b"\x89PNG"
