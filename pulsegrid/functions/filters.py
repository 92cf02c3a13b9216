"""Butterworth band-pass design as second-order sections (driver-side constants for the lane functions)."""

from __future__ import annotations

import numpy as np

#: Share of the Nyquist frequency that a cutoff is clamped to: at it, the pre-warped frequency would be infinite.
BELOW_NYQUIST = 0.999


def clamp_band(low: float, high: float, frequency: float, fps: float) -> tuple[float, float]:
    """The band a filter may have: within 0 and Nyquist, and holding the frequency looked for.

    A band that then begins at 0 or below is refused: its design would have no centre. (Setting it to 0 and going on gives no number.)"""
    low, high = min(max(low, 0.0), frequency), min(high, fps / 2 * BELOW_NYQUIST)
    if not 0 < low < high:
        raise ValueError(f"no band is left between {low} and {high} Hz at {fps} frames a second")
    return low, high


def prototype(order: int) -> np.ndarray:
    """Poles of the analogue low-pass of cutoff 1, evenly spaced on the left half of the unit circle."""
    return np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))


def band_pass_poles(poles: np.ndarray, low: float, high: float) -> np.ndarray:
    """Each low-pass pole p becomes the two roots of s**2 - p * width * s + centre**2."""
    half = poles * (high - low) / 2
    root = np.sqrt(half**2 - low * high + 0j)
    return np.concatenate([half + root, half - root])


def pair_up(z: np.ndarray) -> list[tuple[complex, complex]]:
    """Conjugate partners together; real ones two by two."""
    real = sorted(z[np.abs(z.imag) <= 1e-12 * np.abs(z)].real)
    upper = sorted(z[z.imag > 1e-12 * np.abs(z)], key=abs)
    return [(complex(p), complex(np.conj(p))) for p in upper] + [(complex(a), complex(b)) for a, b in zip(real[::2], real[1::2], strict=True)]


def band_pass_sections(order: int, low: float, high: float, fps: float) -> np.ndarray:
    """[order, 6]: b0, b1, b2, a0, a1, a2 of each section, a0 = 1; gain 1 in the middle of the band."""
    if not 0 < low < high or high >= fps / 2:
        raise ValueError("a band needs 0 < low < high < fps / 2")
    warp = lambda f: 2 * np.tan(np.pi * f / fps)
    analogue = band_pass_poles(prototype(order), warp(low), warp(high))
    digital = (2 + analogue) / (2 - analogue)
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -(p + q).real, (p * q).real] for p, q in pair_up(digital)])
    centre = np.exp(2j * np.arctan(np.sqrt(warp(low) * warp(high)) / 2))
    sections[0, :3] /= abs(response(sections, centre))
    return sections


def response(sections: np.ndarray, z: complex) -> complex:
    powers = np.array([1, 1 / z, 1 / z**2])
    return complex(np.prod(sections[:, :3] @ powers / (sections[:, 3:] @ powers)))
