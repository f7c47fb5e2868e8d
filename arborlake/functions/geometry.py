"""Camera, easing, cost and version arithmetic as column expressions."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def world_to_screen(x: Column, camera_x: float, scale: float, width: float) -> Column:
    return (x - camera_x) * scale + width / 2


def screen_to_world(x: Column, camera_x: float, scale: float, width: float) -> Column:
    return (x - width / 2) / scale + camera_x


def zoom_for_scale(scale: Column, low: float, high: float) -> Column:
    """0..1, linear in the logarithm of the scale."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ln(scale) - F.ln(F.lit(low))) / (F.ln(F.lit(high)) - F.ln(F.lit(low)))))


def scale_for_zoom(zoom: Column, low: float, high: float) -> Column:
    return F.exp(F.ln(F.lit(low)) + zoom * (F.ln(F.lit(high)) - F.ln(F.lit(low))))


def ease_in_out_cubic(t: Column) -> Column:
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3)) / 2)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def backoff(attempt: Column, base: float, factor: float, most: float) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(factor), attempt))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def node_width(label: Column) -> Column:
    return F.greatest(F.lit(72), F.least(F.lit(260), 24 + F.length(label) * 7))


def tick_label(ms: Column, span: Column) -> Column:
    """A time's label, finer for shorter spans (ms)."""
    t = F.timestamp_millis(ms.cast("long"))
    return F.when(span < 86_400_000, F.date_format(t, "HH:mm")).when(span < 31 * 86_400_000.0, F.date_format(t, "MM-dd")).otherwise(F.date_format(t, "yyyy-MM"))


def encode_state(state: dict[str, str]) -> str:
    return "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in sorted(state.items()))


def decode_state(fragment: str) -> dict[str, str]:
    pairs = (p.partition("=") for p in fragment.lstrip("#").split("&") if p)
    return {unquote(k): unquote(v) for k, _, v in pairs}


def satisfies(version: str, wanted: str) -> bool:
    """Whether x.y.z satisfies *, ^x.y.z, ~x.y.z or x.y.z."""
    parts = lambda v: tuple(map(int, re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", v).groups()))
    if wanted == "*":
        return True
    sign, want = (wanted[0], parts(wanted[1:])) if wanted[0] in "^~" else ("", parts(wanted))
    have = parts(version)
    if sign == "":
        return have == want
    fixed = 2 if sign == "~" else 1 if want[0] else 2 if want[1] else 3
    return have >= want and have[:fixed] == want[:fixed]
