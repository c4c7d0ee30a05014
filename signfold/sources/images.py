"""Pixel operators on numpy arrays (height, width, channels) in [0, 1] or uint8, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np


def grid(tiles: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height * width, h, w[, c]) tiles, row by row, as one picture."""
    h, w = tiles.shape[1:3]
    rows = tiles.reshape(height, width, h, w, *tiles.shape[3:])
    return rows.swapaxes(1, 2).reshape(height * h, width * w, *tiles.shape[3:])


def uniform(shape: tuple[int, ...], low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of [low, high)."""
    return low + (high - low) * rng.random(shape)


def blended_pair(left: np.ndarray, right: np.ndarray, width: int, share: float = 0.99) -> np.ndarray:
    """Two square pictures side by side in `width` columns, the overlap blended by a sigmoid that gives the left one `share` at its left end and the right one as much at its right end."""
    size = left.shape[1]
    overlap = 2 * size - width
    if not 0 <= overlap <= size:
        raise ValueError("the width must lie between one picture and two")
    out = np.empty((left.shape[0], width, *left.shape[2:]), dtype=float)
    out[:, : size - overlap], out[:, size:] = left[:, : size - overlap], right[:, overlap:]
    if overlap:
        end = np.log(share / (1 - share))
        t = 1 / (1 + np.exp(-np.linspace(-end, end, overlap)))
        t = t.reshape(1, -1, *([1] * (left.ndim - 2)))
        out[:, size - overlap : size] = (1 - t) * left[:, size - overlap :] + t * right[:, :overlap]
    return out


def rgb_to_hls(x: np.ndarray) -> np.ndarray:
    top, low = x.max(axis=-1), x.min(axis=-1)
    light, spread = (top + low) / 2, top - low
    room = 1 - np.abs(2 * light - 1)
    saturation = np.where(spread > 0, spread / np.where(room > 0, room, 1), 0)
    safe = np.where(spread > 0, spread, 1)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.select([top == r, top == g], [((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4) / 6
    return np.stack([np.where(spread > 0, hue, 0), light, saturation], axis=-1)


def hls_to_rgb(x: np.ndarray) -> np.ndarray:
    hue, light, saturation = np.moveaxis(x, -1, 0)
    chroma = (1 - np.abs(2 * light - 1)) * saturation

    def channel(n: int) -> np.ndarray:
        k = (n + hue * 12) % 12
        return light - chroma / 2 * np.clip(np.minimum(k - 3, 9 - k), -1, 1)

    return np.stack([channel(0), channel(8), channel(4)], axis=-1)


def jitter(x: np.ndarray, hue: float, lightness: float) -> np.ndarray:
    """Hue shifted modulo 1; lightness scaled by 1 - |a| and raised by max(0, a)."""
    h = rgb_to_hls(x)
    h[..., 0] = (h[..., 0] + hue) % 1
    h[..., 1] = (1 - abs(lightness)) * h[..., 1] + max(0.0, lightness)
    return hls_to_rgb(h)


def distort(x: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Bilinear samples at each pixel's place moved by the flow field, borders repeated; the flow fades out at the edges."""
    h, w = x.shape[:2]
    fade = np.minimum.outer(np.sin(np.pi * (np.arange(h) + 0.5) / h), np.sin(np.pi * (np.arange(w) + 0.5) / w))
    y, z = np.mgrid[:h, :w].astype(float)
    y, z = np.clip(y + dy * fade, 0, h - 1), np.clip(z + dx * fade, 0, w - 1)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, h - 1), np.minimum(z0 + 1, w - 1)
    shape = (h, w, *([1] * (x.ndim - 2)))
    fy, fz = (y - y0).reshape(shape), (z - z0).reshape(shape)
    return (1 - fy) * ((1 - fz) * x[y0, z0] + fz * x[y0, z1]) + fy * ((1 - fz) * x[y1, z0] + fz * x[y1, z1])


def gaussian_noise(x: np.ndarray, rng: np.random.Generator, sigma: float = 0.2) -> np.ndarray:
    return x + rng.normal(scale=sigma, size=x.shape)


def to_float(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / 255


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x * 255), 0, 255).astype(np.uint8)


def perlin(height: int, width: int, cells: int, rng: np.random.Generator) -> np.ndarray:
    """Gradient noise of about [-1, 1] on a grid of cells x cells random directions."""
    angle = rng.uniform(0, 2 * np.pi, (cells + 1, cells + 1))
    gy, gx = np.sin(angle), np.cos(angle)
    y = (np.arange(height) + 0.5) / height * cells
    x = (np.arange(width) + 0.5) / width * cells
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]

    def corner(dy: int, dx: int) -> np.ndarray:
        at = np.ix_(y0 + dy, x0 + dx)
        return gy[at] * (fy - dy) + gx[at] * (fx - dx)

    def ease(t: np.ndarray) -> np.ndarray:
        return t * t * t * (t * (t * 6 - 15) + 10)

    u, v = ease(fy), ease(fx)
    top = (1 - v) * corner(0, 0) + v * corner(0, 1)
    low = (1 - v) * corner(1, 0) + v * corner(1, 1)
    return np.sqrt(2) * ((1 - u) * top + u * low)


def noisy(x: np.ndarray, rng: np.random.Generator, hue: float = 1 / 16, lightness: float = 0.2, reach: float = 4.0, cells: int = 4) -> np.ndarray:
    """One noisy instance of a colour picture: a smooth distortion, then hue and lightness jitter."""
    h, w = x.shape[:2]
    moved = distort(x, reach * perlin(h, w, cells, rng), reach * perlin(h, w, cells, rng))
    return jitter(np.clip(moved, 0, 1), rng.uniform(-hue, hue), rng.uniform(-lightness, lightness))
