"""Pixel and colour arithmetic as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rop3(code: Column, pattern: Column, source: Column, target: Column) -> Column:
    """A ternary raster operation on bytes: bit P*4+S*2+D of the code tells the result of each bit."""
    out = F.lit(0)
    for index in range(8):
        term = F.lit(255)
        for k, operand in ((4, pattern), (2, source), (1, target)):
            term = term.bitwiseAND(operand if index & k else F.lit(255).bitwiseXOR(operand))
        out = out.bitwiseOR(F.when(F.shiftright(code, index).bitwiseAND(F.lit(1)) == 1, term).otherwise(F.lit(0)))
    return out


def rop3_uses(code: Column, operand: str) -> Column:
    """Whether a code depends on P, S or D."""
    low, shift = {"P": (0x0F, 4), "S": (0x33, 2), "D": (0x55, 1)}[operand]
    return F.shiftright(code, shift).bitwiseAND(F.lit(low)) != code.bitwiseAND(F.lit(low))


def rop2(mode: Column, pen: Column, target: Column) -> Column:
    """Modes that need no reading of the target and the nop: 1 black, 11 nop, 13 copy, 16 white; 4 inverts the pen; others null."""
    return F.when(mode == 1, 0).when(mode == 4, F.lit(255).bitwiseXOR(pen)).when(mode == 11, target).when(mode == 13, pen).when(mode == 16, 255)


def mask_channel(value: Column, mask: int) -> Column:
    """A channel of a bit-field pixel, scaled to 0..255 and rounded."""
    shift = (mask & -mask).bit_length() - 1
    most = mask >> shift
    return F.floor((F.shiftright(value.bitwiseAND(F.lit(mask)), shift) * 255 + most // 2) / most).cast("int")


def clamp_byte(value: Column) -> Column:
    """Half away from zero, within 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(value))).cast("int")


def color_matrix(channels: list[Column], matrix: list[list[float]]) -> list[Column]:
    """A 5 x 5 matrix on r, g, b, a and 1 (row vector), channels as 0..255."""
    unit = [c / 255.0 for c in channels] + [F.lit(1.0)]
    return [clamp_byte(sum((u * matrix[i][k] for i, u in enumerate(unit)), F.lit(0.0)) * 255) for k in range(4)]


def alpha_valid(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Premultiplied channels may not exceed their alpha."""
    return F.greatest(r, g, b) <= a


def blend(source: Column, target: Column, alpha: Column) -> Column:
    """Straight-alpha blend of bytes, rounded."""
    return F.floor((source * alpha + target * (255 - alpha) + 127) / 255).cast("int")


def colorref(value: Column) -> dict[str, Column]:
    """r, g, b of an RGB colour reference; null for palette indices, whose high byte is 1."""
    high = F.shiftright(value, 24)
    part = lambda s: F.when(high.isin(0, 2), F.shiftright(value, s).bitwiseAND(F.lit(255)))
    return {"r": part(0), "g": part(8), "b": part(16)}


def render_intent(value: Column) -> Column:
    """Logical intents to rendering intents; null for others."""
    return F.when(value.isin(0, 4), 0).when(value == 2, 1).when(value == 1, 2).when(value == 8, 3)


# How a gradient goes on beyond its rectangle.
TILE, FLIP_X, FLIP_Y, FLIP_XY, CLAMP = range(5)


def gradient_parameter(x: Column, y: Column, brush: dict[str, Column]) -> Column:
    """The parameter of a linear gradient at a place: 0 at the left edge of its rectangle, 1 at the right one; null where it has none.

    ``brush`` has the rectangle's ``x, width`` and the matrix ``a`` to ``f`` that puts brush space into the place's space; its inverse
    takes the place back. A matrix without an inverse and a rectangle without a width paint nothing.
    """
    a, b, c, d, e, f = (brush[n] for n in "abcdef")
    det = a * d - b * c
    back = x * (d / det) + y * (-c / det) + -(e * (d / det) + f * (-c / det))
    return F.when((det != 0) & (brush["width"] != 0), back / brush["width"] - brush["x"] / brush["width"])


def wrapped(t: Column, mode: Column) -> Column:
    """The parameter within 0..1: repeated for the tile and flip-y modes, turned back and forth for those that flip x, cut off for clamp."""
    turn = t - 2 * F.floor(t / 2)
    return F.when(mode == CLAMP, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).when(mode.isin(FLIP_X, FLIP_XY), F.when(turn > 1, 2 - turn).otherwise(turn)).otherwise(t - F.floor(t))


def gradient_color(t: Column, stops: Column) -> dict[str, Column]:
    """r, g, b at a parameter among stops (an array of {at, r, g, b} in order of ``at``, which begins at 0 and ends at 1).

    The latest stop up to the parameter and the one behind it are mixed, halves away from zero; of stops at one place the last counts.
    """
    low = F.element_at(F.filter(stops, lambda s: s["at"] <= t), -1)
    high = F.coalesce(F.get(F.filter(stops, lambda s: s["at"] > t), F.lit(0)), low)
    part = F.when(high["at"] > low["at"], (t - low["at"]) / (high["at"] - low["at"])).otherwise(0.0)
    return {c: F.floor(low[c] + (high[c] - low[c]) * part + 0.5).cast("int") for c in "rgb"}
