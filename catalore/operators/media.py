"""Verdicts over decoded pictures: end cards of videos, blur hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Colour of a card, tolerances, shares, seconds, frames a second.
CARD, NEAR_CARD, NEAR_OWN, OWN_SHARE, RUN_SHARE = (12, 13, 25), 8.0, 12.0, 0.45, 0.90
LEAST_RUN_S, LEAST_LEAD_S, MOST_RUN_S, INK, INK_ROWS, FPS = 1.0, 0.40, 5.0, 25, 0.60, 30
#: Fixed value: the digits of a blur hash.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"


def card_frames(frames: np.ndarray) -> np.ndarray:
    """Which of the frames (n, height, width, 3) show a card: near its colour, and mostly one colour."""
    flat = frames.reshape(len(frames), -1, 3).astype(np.float64)
    middle = np.median(flat, axis=1)
    near = np.abs(middle - np.asarray(CARD)).max(1) <= NEAR_CARD
    share = (np.abs(flat - middle[:, None]).max(2) <= NEAR_OWN).mean(1)
    return near & (share >= OWN_SHARE)


def outro(frames: np.ndarray) -> tuple[float | None, str]:
    """(seconds of end card or None, reason) for the last frames of a video.

    The card is the longest end of the clip that starts with a card frame and
    has a share of RUN_SHARE of them; it must be long enough, begin inside the
    clip, be no longer than cards are, and have few rows with anything on them.
    """
    cards = card_frames(frames)
    n = len(cards)
    share = np.cumsum(cards[::-1])[::-1] / np.arange(n, 0, -1)
    starts = np.flatnonzero(cards & (share >= RUN_SHARE))
    start = int(starts[0]) if len(starts) else n
    run, lead = (n - start) / FPS, start / FPS
    if run < LEAST_RUN_S:
        return None, "no run"
    if lead < LEAST_LEAD_S:
        return None, "no boundary"
    if run > MOST_RUN_S:
        return None, "too long"
    inked = (np.abs(frames[-1].astype(int) - np.asarray(CARD)).max(2) > INK).any(1).mean()
    return (None, "layout") if inked > INK_ROWS else (run, "card")


def _digits(value: int, n: int) -> str:
    return "".join(DIGITS[value // 83**i % 83] for i in reversed(range(n)))


def blurhash(pixels: np.ndarray, nx: int = 4, ny: int = 3) -> str:
    """The blur hash of an RGB picture (height, width, 3)."""
    c = pixels.astype(np.float64) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    h, w = linear.shape[:2]
    bx, by = np.cos(np.pi * np.arange(nx)[:, None] * np.arange(w) / w), np.cos(np.pi * np.arange(ny)[:, None] * np.arange(h) / h)
    waves = np.einsum("jy,yxc,ix->jic", by, linear, bx) / (h * w) * 2
    waves[0, 0] /= 2
    flat = waves.reshape(-1, 3)
    srgb = lambda v: np.rint(255 * np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)).astype(int).clip(0, 255)
    mean = srgb(flat[0])
    rest = flat[1:]
    top = int(np.clip(np.floor(np.abs(rest).max() * 166 - 0.5), 0, 82)) if len(rest) else 0
    scale = (top + 1) / 166
    coded = np.clip(np.floor(np.sign(rest) * np.sqrt(np.abs(rest / scale)) * 9 + 9.5), 0, 18).astype(int)
    return _digits(nx - 1 + (ny - 1) * 9, 1) + _digits(top, 1) + _digits(int(mean[0]) << 16 | int(mean[1]) << 8 | int(mean[2]), 4) + "".join(_digits(int(a * 361 + b * 19 + d), 2) for a, b, d in coded)


def outros(videos: DataFrame) -> DataFrame:
    """(item_id, content_end_ms, outro_kind, reason) of (item_id, frames, height, width, duration_ms).

    ``frames`` holds the last frames of a video as RGB bytes, one after the
    other. Without a card, or without a whole frame, the first two are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, frames, height, width, length in zip(*[batch[c] for c in ("item_id", "frames", "height", "width", "duration_ms")]):
                size = 3 * int(height) * int(width) if pd.notna(height) and pd.notna(width) else 0
                raw = bytes(frames) if frames is not None else b""
                if not size or len(raw) < size or len(raw) % size:
                    rows.append((item, None, None, "no frames"))
                    continue
                run_s, reason = outro(np.frombuffer(raw, np.uint8).reshape(-1, int(height), int(width), 3))
                end = None if run_s is None or pd.isna(length) else max(int(length) - round(1000 * run_s), 0)
                rows.append((item, end, None if run_s is None else "card", reason))
            yield pd.DataFrame(rows, columns=["item_id", "content_end_ms", "outro_kind", "reason"]).astype({"content_end_ms": "Int64"})

    return videos.select("item_id", "frames", "height", "width", "duration_ms").mapInPandas(run, "item_id long, content_end_ms long, outro_kind string, reason string")


def blurhashes(pictures: DataFrame, nx: int = 4, ny: int = 3) -> DataFrame:
    """(item_id, blurhash) of (item_id, pixels, height, width), pixels as RGB bytes; null where they don't fit the size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = []
            for pixels, height, width in zip(batch["pixels"], batch["height"], batch["width"]):
                size = 3 * int(height) * int(width) if pd.notna(height) and pd.notna(width) else 0
                whole = size and pixels is not None and len(pixels) == size
                codes.append(blurhash(np.frombuffer(bytes(pixels), np.uint8).reshape(int(height), int(width), 3), nx, ny) if whole else None)
            yield pd.DataFrame({"item_id": batch["item_id"], "blurhash": codes})

    return pictures.select("item_id", "pixels", "height", "width").mapInPandas(run, "item_id long, blurhash string")
