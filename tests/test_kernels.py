import numpy as np
import pytest

from pixelframe.functions import kernels as k
from pixelframe.operators import drawplan


@pytest.fixture
def sample():
    image = np.zeros((20, 30, 3), np.uint8)
    image[:, :15], image[:, 15:], image[0, 0] = (50, 100, 150), (200, 60, 10), 255
    return image


CALLS = [lambda i: k.flip(i), lambda i: k.rotate(i), lambda i: k.shear(i, 0.2, 0.1), lambda i: k.skew(i), lambda i: k.crop(i), lambda i: k.distortion(i), lambda i: k.blur(i)]


@pytest.mark.parametrize("call", CALLS)
def test_shape_and_type_stay(sample, call):
    out = call(sample)
    assert out.shape == sample.shape and out.dtype == np.uint8


def test_flip_is_its_own_inverse(sample):
    assert np.array_equal(k.flip(sample), sample[:, ::-1]) and np.array_equal(k.flip(k.flip(sample)), sample)


@pytest.mark.parametrize("call", [lambda i: k.rotate(i, 0), lambda i: k.shear(i, 0, 0), lambda i: k.skew(i, 0, 0), lambda i: k.crop(i, 1.0), lambda i: k.distortion(i, 0)])
def test_nothing_asked_changes_nothing(sample, call):
    assert np.array_equal(call(sample), sample)


def test_outside_is_white():
    black = np.zeros((20, 30, 3), np.uint8)
    assert k.rotate(black, 45).max() == 255 and k.shear(black, 0.4, 0).max() == 255
    assert k.distortion(black, 0.3)[0, 0].tolist() == [255, 255, 255]


def test_shear_moves_a_marker_right():
    image = np.zeros((40, 40, 3), np.uint8)
    image[10, 10, 0] = 255
    out = k.shear(image, 0.5, 0.0)[..., 0]
    assert out[10, 15] == 255


def test_crop_keeps_white_and_follows_its_seed():
    white, ramp = np.full((40, 40, 3), 255, np.uint8), np.zeros((40, 40, 3), np.uint8)
    ramp[..., 0], ramp[..., 1] = np.arange(40) * 6, (np.arange(40) * 6)[:, None]
    assert k.crop(white).min() == 255
    a, b = (k.crop(ramp, 0.5, np.random.RandomState(s)) for s in (0, 1))
    assert not np.array_equal(a, b)


def test_components_touch_by_corners_and_fill_holes():
    mask = np.zeros((9, 9), bool)
    mask[1:6, 1:6] = True
    mask[3, 3] = False
    mask[6, 6] = mask[8, 0] = True
    labels, areas = k.components(mask)
    assert labels[3, 3] == labels[6, 6] == 10 and areas == {10: 16.0, 72: 0.0}
    assert k.box(k.largest(mask)) == (1, 1, 6, 6) and k.largest(np.zeros((4, 4), bool)) is None


def test_blur_must_be_odd(sample):
    with pytest.raises(ValueError):
        k.blur(sample, 4)
    assert np.array_equal(k.blur(np.full((9, 9, 3), 7, np.uint8)), np.full((9, 9, 3), 7))


def test_draws_are_those_of_the_seed():
    rows = list(drawplan.draws(5, 42))
    assert [r[1] for r in rows] == [942484272, 202244314, 1688060240, 1382689815, 487991438]
    assert [r[2] for r in rows] == [["Flip", "Crop"], ["Crop", "Flip"], ["Skew", "Crop"], ["Flip", "Distortion"], ["Distortion", "Shear"]]
    assert rows[0][3][1][1]["scale"] == pytest.approx(0.957579, abs=1e-6)
    with pytest.raises(ValueError, match="K=2"):
        next(drawplan.draws(1, 42, pool=drawplan.POOL[:1]))


def test_lookup_tells_all_unknown_names():
    assert [m.name for m in drawplan.lookup("rotate, FLIP")] == ["Rotate", "Flip"] and drawplan.lookup(" ") is None
    with pytest.raises(ValueError, match="Blur, Warp"):
        drawplan.lookup("Blur,flip,Warp")
