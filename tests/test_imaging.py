import numpy as np
import pytest
from framesift.functions import imaging as I


def solid(v, h=100, w=100):
    return np.full((h, w, 3), v, np.uint8)


def sample():
    a = np.zeros((100, 100, 3), np.uint8)
    a[:50, :50] = (255, 0, 0)
    a[:50, 50:] = (0, 255, 0)
    a[50:, :50] = (0, 0, 255)
    a[50:, 50:] = 255
    return a


def test_to_rgb():
    assert I.to_rgb(np.ones((4, 5), np.uint8)).shape == (4, 5, 3)
    assert I.to_rgb(np.ones((4, 5, 1), np.uint8)).shape == (4, 5, 3)
    assert (I.to_rgb(np.dstack([sample(), np.zeros((100, 100), np.uint8)])) == sample()).all()
    assert I.to_rgb(np.array([[0.5, 1.7, -1.0]]))[0, :, 0].tolist() == [127, 255, 0]
    assert I.to_rgb(np.array([[30000]], np.uint16))[0, 0, 0] == 48
    with pytest.raises(ValueError, match="Expected 1, 3, or 4 channels"):
        I.to_rgb(np.zeros((2, 2, 2), np.uint8))
    with pytest.raises(ValueError, match="Expected 2D or 3D array"):
        I.to_rgb(np.zeros((1, 2, 2, 3), np.uint8))


def test_blocks():
    assert I.grid(1080, 1920, 32) == (33, 60)
    assert I.block_means(sample(), 50).shape == (2, 2, 3)
    assert I.block_means(sample(), 128).size == 0
    assert not I.block_diff(solid(100), solid(110), 50).any()  # exactly the threshold is no change
    assert I.block_diff(solid(100), solid(111), 50).all()
    assert I.regions_of(np.array([[False, True], [True, False]]), 50) == [(50, 0, 50, 50), (0, 50, 50, 50)]


def test_blank_and_crop():
    a = I.blank(solid(9, 10, 10), [(-5, -5, 8, 8), (8, 8, 50, 50)])
    assert a[:3, :3].sum() == 0 and a[8:, 8:].sum() == 0 and a[5, 5, 0] == 9
    assert I.crop(a, 20, 20, 5, 5).size == 0 and I.crop(a, -2, -2, 5, 5).shape == (3, 3, 3)


def test_gray():
    assert I.gray(solid(255))[0, 0] == 254 and I.luma(solid(255))[0, 0] == 255


def test_phash():
    a = sample()
    assert len(I.phash(a)) == 16 and I.phash(a) == I.phash(a.copy())
    assert {I.phash(solid(v)) for v in (0, 50, 128, 255)} == {"0" * 16}
    assert I.phash(a, 1) == "0"
    noise = np.random.default_rng(0).integers(0, 256, (320, 320, 3)).astype(np.uint8)
    lower = noise.copy()
    lower[200:] = 0
    assert I.phash(noise) == I.phash(lower)  # only the top rows count
    assert I.hamming("ff", "f0") == 4


def test_tiles():
    assert I.tiles(300, 100) == [(0, 100), (100, 200), (200, 300)]
    assert I.tiles(250, 100)[-1] == (200, 250)
    assert len(I.phash_tiles(np.zeros((50, 100, 3), np.uint8), 100)) == 1


def test_resize_keeps_flat_and_size():
    assert (I.resize(np.full((37, 53), 200, np.uint8), 32, 32) == 200).all()
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (I.resize(a, 8, 8) == a).all()


def brute_ssim(a, b):
    out = []
    for y in range(a.shape[0] - 6):
        for x in range(a.shape[1] - 6):
            p, q = a[y : y + 7, x : x + 7].astype(float).ravel(), b[y : y + 7, x : x + 7].astype(float).ravel()
            cov = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225)))
    return np.mean(out)


def test_ssim():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (2, 20, 30)).astype(np.uint8)
    assert I.ssim(a, a) == pytest.approx(1.0) and I.ssim(a, b) == pytest.approx(brute_ssim(a, b))
    with pytest.raises(ValueError):
        I.ssim(a[:5], b[:5])


def test_compare():
    big = solid(128)
    big[20:80, 20:80] = 0
    small = sample()
    small[10:15, 10:15] = 128
    s, change, pct, regions = I.compare(big, sample(), 32)
    assert s < 0.5 and change == 1 - s and pct == 100 and len(regions) == 9
    assert I.compare(small, sample(), 32)[0] > 0.95
    assert I.compare(sample(), sample(), 32) == (pytest.approx(1.0), pytest.approx(0.0), 0.0, [])
