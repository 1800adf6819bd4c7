import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import kernels
from pixelframe.operators import distribution, drawplan
from pixelframe.plans import jobs
from pixelframe.sources import images, sinks
from pixelframe.streaming.images import transform_stream


def picture(i=0):
    image = np.full((8, 8, 3), (40, 150 + i, 60), np.uint8)
    image[0, i % 8] = 0
    return kernels.png(image)


@pytest.fixture
def folder(tmp_path):
    """Two classes of PNG files with a copy, a text and a broken file, and an empty class."""
    for name, n in (("healthy", 3), ("rust", 1)):
        (tmp_path / "in" / name).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "in" / name / f"image ({i}).PNG").write_bytes(picture(i))
    shutil.copy(tmp_path / "in/healthy/image (0).PNG", tmp_path / "in/healthy/copy.png")
    (tmp_path / "in/rust/notes.txt").write_text("x")
    (tmp_path / "in/none").mkdir()
    return tmp_path


def counts(rows, of="class"):
    return {c: sum(r[of] == c for r in rows) for c in {r[of] for r in rows}}


def test_distribution_counts_empty_classes(spark, folder, monkeypatch):
    expected = {"healthy": 4, "rust": 1, "none": 0}
    (folder / "in/healthy/deep").mkdir()
    (folder / "in/healthy/deep/more.png").write_bytes(picture())
    monkeypatch.chdir(folder)
    spark_home = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    for path in (str(folder / "in"), f"file://{folder}/in/", os.path.relpath(folder / "in", spark_home)):
        found = jobs.class_distribution(spark, path)
        assert {r["class"]: r["n"] for r in found.collect()} == expected
    assert [r.n for r in jobs.class_distribution(spark, str(folder / "in/healthy")).collect()] == [4]
    text = distribution.report(found)
    assert text.splitlines()[2] == f"{'Disease Type':<30} {'Count':>10} {'Percentage':>10}" and f"{'healthy':<30} {4:>10} {80.0:>9.1f}%" in text
    path = distribution.save_chart(found, "apple", str(folder / "charts"))
    assert path.endswith("charts/apple_class_distribution.svg") and "healthy 80.0%" in open(path).read()


def test_augment_fills_classes_and_writes(spark, folder):
    made = jobs.augment(spark, str(folder / "in")).collect()
    assert counts(made) == {"healthy": 1, "rust": 3}
    again = jobs.augment(spark, str(folder / "in")).collect()
    assert sorted((r["output"], bytes(r["data"])) for r in made) == sorted((r["output"], bytes(r["data"])) for r in again)
    written = jobs.augment(spark, str(folder / "in"), dst=f"file://{folder}/out", copy_raw=True).collect()
    assert len(written) == 4 + 4 and len(list((folder / "out/rust").iterdir())) == 4
    with pytest.raises(ValueError):
        jobs.augment(spark, str(folder / "in"), dst=str(folder / "in/out"))


def test_augment_sees_direct_children_only(spark, tmp_path):
    for name, n in (("a", 2), ("b", 1), ("a/deep", 3)):
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        for i in range(n):
            (tmp_path / "in" / name / f"{name[-1]}{i}.png").write_bytes(picture(i))
    assert counts(jobs.augment(spark, str(tmp_path / "in")).collect()) == {"b": 1}
    # A class folder ignores ``balanced`` and needs a target.
    made = jobs.augment(spark, str(tmp_path / "in/a"), dst=str(tmp_path / "out"), target=5, balanced=True).collect()
    assert len(made) == 3 and {p.parent.name for p in (tmp_path / "out").rglob("*.png")} == {"a"}
    with pytest.raises(ValueError, match="target"):
        jobs.augment(spark, str(tmp_path / "in/a"), balanced=True)
    with pytest.raises(ValueError, match="no images"):
        (tmp_path / "empty").mkdir()
        jobs.augment(spark, str(tmp_path / "empty"))


def test_augment_of_one_image_goes_straight_to_its_target(spark, folder):
    (folder / "in2 (1) [x]").mkdir()
    (folder / "in2 (1) [x]/x.png").write_bytes(picture())
    jobs.augment(spark, str(folder / "in2 (1) [x]/x.png"), dst=str(folder / "one"), n=3, copy_raw=True).collect()
    names = sorted(p.name for p in (folder / "one").iterdir())
    assert len(names) == 4 and "x.png" in names and (folder / "one/x.png").read_bytes() == picture()


def test_augment_uses_kernels_of_ones_own(spark, folder):
    kernels.register("Invert", lambda image: 255 - image)
    pool = [drawplan.Method("Invert", {}), drawplan.Method("Dim", {"by": (2.0, 2.0)}, lambda image, by: (image / by).astype(np.uint8))]
    try:
        row = jobs.augment(spark, str(folder / "in/rust/image (0).PNG"), n=1, methods="invert, dim", pool=pool).first()
    finally:
        del kernels.KERNELS["Invert"]
    image = np.full((8, 8, 3), (40, 150, 60), np.uint8)
    image[0, 0] = 0
    assert row.output == "image (0)_Invert_Dim_0.PNG" and bytes(row.data) == ((255 - image) / 2).astype(np.uint8).tobytes()


def test_transform_reads_what_it_wrote(spark, folder):
    (folder / "in/rust/broken.png").write_bytes(b"no image")
    written = jobs.transform(spark, str(folder / "in"), ("blur", "mask"), f"file://{folder}/t").collect()
    assert len(written) == 10
    back = images.scan_images(spark, str(folder / "t/blur"))
    assert back.count() == 5 and {(r.height, r.width) for r in back.select("height", "width").collect()} == {(8, 8)}
    with pytest.raises(ValueError):
        jobs.transform(spark, str(folder / "in"), strength=4)
    assert [(r.path.rpartition("/")[2], r["class"], r.reason) for r in images.rejected(spark, str(folder / "in")).collect()] == [("broken.png", "rust", "unknown kind")]
    with pytest.raises(Exception, match="cannot decode"):
        images.scan_images(spark, str(folder / "in"), strict=True).collect()


def test_transform_keeps_files_of_one_stem_apart(spark, tmp_path):
    src = tmp_path / "in2 (1)"
    (src / "c").mkdir(parents=True)
    for name in ("x.png", "x.PNG", "x.jpg"):
        (src / "c" / name).write_bytes(picture())
    written = jobs.transform(spark, str(src), ("blur",), str(tmp_path / "t")).collect()
    assert len(written) == 3 and sorted(p.name for p in (tmp_path / "t/blur/c").iterdir()) == ["x_blur.PNG", "x_blur.jpg", "x_blur.png"]


def test_transform_of_one_file_and_histograms(spark, folder):
    (folder / "taken.txt").write_text("x")
    written = jobs.transform(spark, str(folder / "in"), ("histogram", "analyze"), str(folder / "taken.txt"), file="rust/image (0).PNG").collect()
    assert sorted(os.path.relpath(r.path, folder) for r in written) == ["analyze/image (0)_analyze.PNG", "histogram/image (0)_histogram.png"]
    assert {(r.height, r.width) for r in images.scan_images(spark, str(folder / "histogram")).collect()} == {(400, 700)}
    assert jobs.transform(spark, str(folder / "in"), ("histogram",)).count() == 5
    with pytest.raises(ValueError, match="no file"):
        jobs.transform(spark, str(folder / "in"), file="rust")


def test_curves_follow_the_values_of_the_mask():
    image, mask = np.full((6, 6, 3), (0, 255, 0), np.uint8), np.zeros((6, 6), bool)
    mask[2:4, 2:4] = True
    chart = kernels.histogram_chart(image, mask)
    assert chart.shape == (400, 700, 3) and (chart[21:379, 679] != 255).any() and (chart[21:379, 400] == 255).all()


def test_draws_in_blocks_are_one_stream(spark):
    whole, parts = (sorted(map(repr, drawplan.draw_plan(spark, 25, 7, block=b).collect())) for b in (100, 4))
    assert whole == parts and len(whole) == 25
    assert drawplan.draw_plan(spark, 0, 7).count() == 0


def test_stream_transforms_what_arrives(spark, tmp_path, tables):
    pixels = images.embeddings_as_images(spark, tables).limit(5).withColumns({"image_id": F.col("image_id").cast("string"), "class": F.col("class").cast("string")})
    pixels.write.parquet(str(tmp_path / "in"))
    transform_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ("blur",)).awaitTermination(120)
    assert counts(spark.read.parquet(str(tmp_path / "out")).collect(), "transform") == {"blur": 5, "original": 5}


def test_bmp_is_read_back(spark, tmp_path):
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    rows = spark.createDataFrame([("a.bmp", 5, 7, bytearray(image.tobytes()))], "output string, height int, width int, data binary")
    assert sinks.write_files(rows, str(tmp_path / "b")).count() == 1
    assert bytes(images.scan_images(spark, str(tmp_path / "b"), (".bmp",)).first().data) == image.tobytes()
