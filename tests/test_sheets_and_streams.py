"""Contact sheets pixel by pixel, and duplicates told over several batches of a stream."""

import hashlib
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from pixelframe.functions import kernels, sheets
from pixelframe.operators import features
from pixelframe.plans import jobs
from pixelframe.queries import QUERIES
from pixelframe.sources import images
from pixelframe.sources.images import embeddings_as_images
from pixelframe.streaming.images import dedup_stream, running_counts


def by_area(image, h, w):
    """Means of areas, exactly, one pixel after another."""
    ih, iw = image.shape[:2]
    out = np.zeros((h, w, 3), np.uint8)
    cover = lambda a, b, k: max(Fraction(0), min(b, Fraction(k + 1)) - max(a, Fraction(k)))
    for y in range(h):
        for x in range(w):
            top, low, left, right = Fraction(y * ih, h), Fraction((y + 1) * ih, h), Fraction(x * iw, w), Fraction((x + 1) * iw, w)
            for c in range(3):
                total = sum(cover(top, low, i) * cover(left, right, j) * int(image[i, j, c]) for i in range(ih) for j in range(iw))
                # Halves go down: sums in floats end up a little below or above them.
                mean = total / ((low - top) * (right - left)) + Fraction(1, 2)
                out[y, x, c] = int(mean) - (mean == int(mean) and mean > 0)
    return out


def test_sheets_against_one_loop(spark, tables):
    found = {r.image_id: (r.height, r.width, r.sha256) for r in QUERIES["contact_sheets"](spark, tables).collect()}
    rows = {r.image_id: np.frombuffer(r.data, np.uint8).reshape(8, 8, 3) for r in embeddings_as_images(spark, tables).collect()}
    assert found.keys() == rows.keys()
    for key in sorted(rows)[:25]:
        parts = [part for _, part in features.transformed(rows[key])]
        across, down = min(3, len(parts)), -(-len(parts) // 3)
        out = np.full((down * 6 + 1, across * 6 + 1, 3), 255, np.uint8)
        for nth, part in enumerate(parts):
            small = sheets.fitted(part, 5) if part.shape[0] > 8 else by_area(part, 5, 5)  # charts are larger, see below
            top, left = 1 + nth // 3 * 6 + (5 - small.shape[0]) // 2, 1 + nth % 3 * 6 + (5 - small.shape[1]) // 2
            out[top : top + small.shape[0], left : left + small.shape[1]] = small
        assert found[key] == (*out.shape[:2], hashlib.sha256(out.tobytes()).hexdigest())


def test_areas_of_any_size():
    random = np.random.default_rng(3)
    for shape, to in (((9, 14), (4, 5)), ((7, 3), (1, 1)), ((6, 6), (6, 6)), ((13, 8), (12, 3))):
        image = random.integers(0, 256, (*shape, 3)).astype(np.uint8)
        assert np.array_equal(sheets.shrink(image, *to), by_area(image, *to))
    assert sheets.fitted(np.zeros((400, 700, 3), np.uint8), 70).shape == (40, 70, 3) and sheets.fitted(np.zeros((1, 900, 3), np.uint8), 9).shape == (1, 9, 3)
    assert sheets.sheet([], 4, 3, 1).shape == (5, 5, 3)
    with pytest.raises(ValueError, match="column"):
        sheets.sheet([], 0)


def test_shrinking_copies_an_image_once():
    chart = np.random.default_rng(4).integers(0, 256, (400, 700, 3)).astype(np.uint8)
    sheets.shrink(chart, 2, 5)
    tracemalloc.start()
    sheets.shrink(chart, 2, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * 8 * chart.size


def test_later_curves_over_earlier_ones():
    x, y = np.array([0, 4, 8]), np.array([[0, 5, 1], [5, 0, 5], [2, 2, 9]])
    colours = [(255, 0, 0), (0, 255, 0), (0, 0, 255)]
    one, all_at_once = np.zeros((7, 9, 3), np.uint8), np.zeros((7, 9, 3), np.uint8)
    for curve, colour in zip(y, colours, strict=True):
        for k in range(2):
            kernels.line(one, (x[k], curve[k]), (x[k + 1], curve[k + 1]), colour)
    kernels.polylines(all_at_once, x, y, colours)
    assert np.array_equal(one, all_at_once) and len(np.unique(one.reshape(-1, 3), axis=0)) == 4


class Rows:
    """What map_images() asks of a DataFrame, and the function that it would run in tasks."""

    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("class", T.IntegerType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_lists_count_in_what_a_task_holds(monkeypatch):
    monkeypatch.setattr(kernels, "SENT", 1 << 18)
    one = {"image_id": 1, "class": 0, "height": 8, "width": 8, "data": bytes(192)}
    batch = pa.RecordBatch.from_pylist([one] * 100)
    for counts in (np.arange(2304), list(range(2304))):
        rows = Rows()
        kernels.map_images(rows, lambda image, row, counts=counts: iter([{"counts": counts}]), "counts array<long>")
        sent = list(rows.run(iter([batch])))
        assert sum(b.num_rows for b in sent) == 100 and max(b.nbytes for b in sent) < 2 * kernels.SENT
        assert sent[0].column("counts")[0].as_py() == list(range(2304))


def picture(i):
    image = np.full((12, 12, 3), (40, 150 + i, 60), np.uint8)
    image[0] = 0
    return kernels.png(image)


def test_previews_are_written_below_their_folders(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    for i in range(2):
        (tmp_path / f"in/a/x{i}.png").write_bytes(picture(i))
    assert jobs.preview(spark, str(tmp_path / "in"), str(tmp_path / "out"), cell=32).count() == 2
    assert {(r.name, r.height, r.width) for r in images.scan_images(spark, str(tmp_path / "out")).collect()} == {(f"x{i}_preview.png", 2 * 40 + 8, 4 * 40 + 8) for i in range(2)}
    assert jobs.preview(spark, str(tmp_path / "in/a/x0.png"), str(tmp_path / "one"), transforms=("blur",)).count() == 1 and (tmp_path / "one/x0_preview.png").exists()


def test_copies_over_batches_keep_the_first(spark, tmp_path):
    def add(**files):
        for name, i in files.items():
            kind, _, name = name.partition("_")
            (tmp_path / "in" / kind).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / kind / f"{name}.png").write_bytes(picture(i))

    def run():
        query = dedup_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert query.exception() is None
        told = {(r["class"], r.name[:-4], r.is_kept) for r in spark.read.parquet(str(tmp_path / "out/files")).collect()}
        return told, {(r["class"], r.raw, r.kept) for r in running_counts(spark, str(tmp_path / "out")).collect()}

    add(a_m=1, a_k=1, a_z=2, b_m=1)
    (tmp_path / "in/a/notes.txt").write_text("x")
    first = {("a", "k", True), ("a", "m", False), ("a", "z", True), ("b", "m", True)}
    assert run() == (first, {("a", 3, 2), ("b", 1, 1)})
    # Copies of the batch before: their names come first, but they came later.
    add(a_a=1, a_n=3, b_a=1, c_m=1)
    assert run() == (first | {("a", "a", False), ("a", "n", True), ("b", "a", False), ("c", "m", True)}, {("a", 5, 3), ("b", 2, 1), ("c", 1, 1)})
    assert run()[1] == {("a", 5, 3), ("b", 2, 1), ("c", 1, 1)}
