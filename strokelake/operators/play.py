"""Playing records: an ordered fold gives each record its device context, and native expressions draw with it.

The fold keeps what is a stack or a table of handles: saved contexts, objects and the current position. It emits one small
struct a record; all geometry and colour stays in Spark's expressions.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strokelake.functions import geometry

from . import replay

#: The context of a record: mapping, position before the record, colours of the selected pen and brush, and modes.
CONTEXT = {
    "worg_x": 0.0, "worg_y": 0.0, "wext_x": 1.0, "wext_y": 1.0, "vorg_x": 0.0, "vorg_y": 0.0, "vext_x": 1.0, "vext_y": 1.0, "x": 0.0, "y": 0.0,
    "pen": 0.0, "brush": 16777215.0, "text_color": 0.0, "bk_color": 16777215.0, "bk_mode": 2.0, "rop2": 13.0, "poly_fill": 1.0, "map_mode": 1.0, "pen_slot": -1.0, "brush_slot": -1.0,
}

_SCALARS = {"SetTextColor": ("text_color", "color"), "SetBkColor": ("bk_color", "color"), "SetBkMode": ("bk_mode", "mode"), "SetROP2": ("rop2", "mode"), "SetPolyFillMode": ("poly_fill", "mode")}
_PAIRS = {"SetWindowOrg": "worg", "SetWindowExt": "wext", "SetViewportOrg": "vorg", "SetViewportExt": "vext"}
#: All kinds take a slot; only pens and brushes of one colour are drawn with.
_CREATES = {
    "CreatePenIndirect": "pen", "CreatePen": "pen", "ExtCreatePen": "pen", "CreateBrushIndirect": "brush", "CreatePatternBrush": "brush", "DIBCreatePatternBrush": "brush", "CreateMonoBrush": "brush", "CreateDIBPatternBrushPt": "brush",
    "CreateFontIndirect": "font", "ExtCreateFontIndirectW": "font", "CreatePalette": "palette", "CreateRegion": "region", "CreateColorSpace": "colour space", "CreateColorSpaceW": "colour space",
}
# Stock objects by number, with their colours; null brush and pen have none.
STOCK = {0: ("brush", 0xFFFFFF), 1: ("brush", 0xC0C0C0), 2: ("brush", 0x808080), 3: ("brush", 0x404040), 4: ("brush", 0), 5: ("brush", None), 6: ("pen", 0xFFFFFF), 7: ("pen", 0), 8: ("pen", None)}
#: What a context falls back to when its selected object is deleted.
_FALLBACK = {"pen": 0.0, "brush": 16777215.0}
#: Millimetres a pixel: of 96 pixels an inch.
PIXEL_MM = 25.4 / 96

#: Records that change nothing that is drawn here, or only what the fold keeps.
_SILENT = {"EOF", "Header", "RealizePalette", "SetRelAbs", "SetMapperFlags", "SetMiterLimit", "SetBrushOrg", "EndOfFile"}

#: What is drawn, lines and pixels first, then shapes in boxes.
DRAWN = ("LineTo", "SetPixel", "Rectangle", "Ellipse", "RoundRect", "Arc", "Pie", "Chord")

SCHEMA = "file string, seq int, depth int, fault string, " + ", ".join(f"{k} double" for k in CONTEXT)


def _isotropic(dc: dict) -> None:
    """In mode 7 one unit is as long on both axes; the longer one is shortened. Pixels are square here."""
    if dc["map_mode"] == 7:
        x, y = abs(dc["vext_x"] / dc["wext_x"]), abs(dc["vext_y"] / dc["wext_y"])
        if x > y:
            dc["vext_x"] = math.copysign(abs(dc["wext_x"]) * y, dc["vext_x"])
        elif y > x:
            dc["vext_y"] = math.copysign(abs(dc["wext_y"]) * x, dc["vext_y"])


def _set_mode(dc: dict, mode: float) -> None:
    if mode == 1:
        dc.update(wext_x=1.0, wext_y=1.0, vext_x=1.0, vext_y=1.0)
    elif mode in geometry.UNITS_PER_MM:
        unit = geometry.UNITS_PER_MM[int(mode)]
        dc.update(wext_x=unit, wext_y=unit, vext_x=1 / PIXEL_MM, vext_y=-1 / PIXEL_MM)
    elif mode not in (7, 8):
        return  # the call failed, and the mode stays
    dc["map_mode"] = mode
    _isotropic(dc)


def _step(dc: dict, saved: list, objects: dict, free: list, name: str, f: dict) -> str | None:
    """Applies one record; returns what is wrong with it, if anything."""
    plain = name.removesuffix("Ex")
    if plain in _SCALARS:
        key, field = _SCALARS[plain]
        dc[key] = f[field]
    elif plain == "SetMapMode":
        _set_mode(dc, f["mode"])
    elif plain in _PAIRS:
        # Extents count in the modes that keep them only, and never as zero.
        if not plain.endswith("Ext") or dc["map_mode"] in (7, 8) and f["x"] and f["y"]:
            dc[f"{_PAIRS[plain]}_x"], dc[f"{_PAIRS[plain]}_y"] = f["x"], f["y"]
            if plain.endswith("Ext"):
                _isotropic(dc)
    elif plain in ("OffsetWindowOrg", "OffsetViewportOrg"):
        key = "worg" if "Window" in plain else "vorg"
        dc[f"{key}_x"] += f["x"]
        dc[f"{key}_y"] += f["y"]
    elif plain in ("MoveTo", "LineTo"):
        dc["x"], dc["y"] = f["x"], f["y"]
    elif plain == "SaveDC":
        saved.append(dict(dc))
    elif plain == "RestoreDC":
        level = int(f["level"])
        to = len(saved) + level if level < 0 else level - 1
        if level == 0 or not 0 <= to < len(saved):
            return "restore level"
        dc.update(saved[to])
        del saved[to:]
    elif name in _CREATES:
        if "object" in f:
            slot = int(f["object"])
        else:
            slot = heapq.heappop(free) if free else None
        if slot is None or slot in objects:
            return "object slot"
        objects[slot] = (_CREATES[name], f.get("color"))
    elif plain == "SelectObject":
        slot = int(f["object"])
        number = slot - 0x80000000
        if number > 19 or number in (9, 15) or number < 0 and slot not in objects:
            return "unknown object"
        kind, color = objects[slot] if number < 0 else STOCK.get(number, ("other", None))
        if kind in ("palette", "colour space"):
            return "object kind"
        if kind in _FALLBACK:
            dc[kind], dc[f"{kind}_slot"] = color, float(slot) if number < 0 else -1.0
    elif plain == "DeleteObject":
        slot = int(f["object"])
        if objects.pop(slot, None) is None:
            return "unknown object"
        heapq.heappush(free, slot)
        for kind, color in _FALLBACK.items():
            if dc[f"{kind}_slot"] == slot:
                dc[kind], dc[f"{kind}_slot"] = color, -1.0
    return None


class _Contexts:
    """The context before each record of a file."""

    def __init__(self, slots: int):
        self.slots = slots

    def begin(self) -> None:
        self.dc, self.saved, self.objects, self.free = dict(CONTEXT), [], {}, list(range(self.slots))

    def step(self, name: str | None, fields: list | None, *_) -> tuple:
        before = tuple(self.dc.values())
        fault = _step(self.dc, self.saved, self.objects, self.free, name or "", dict(fields or ()))
        return len(self.saved), fault, *before


def contexts(decoded: DataFrame, slots: int = 4096) -> DataFrame:
    """``file, seq, depth, fault`` and the context before each record of the decoded records ``file, seq, name, fields``.

    A record that can't be applied is reported in ``fault`` and changes nothing. A task steps through many files, a file of any size in one task.
    """

    added = StructType.fromDDL(SCHEMA.removeprefix("file string, seq int, "))
    rows = decoded.select("file", "seq", "name", "fields")
    played = replay.replay(rows, ["file"], "seq", _Contexts(slots), [F.col("name"), F.col("fields")], added)
    return played.select("file", "seq", *added.names)


def operations(decoded: DataFrame, played: DataFrame, far_edges: bool = False) -> DataFrame:
    """``file, seq, op, shape, points, color``: lines, boxes and pixels in device space from records and their contexts.

    Only records without a fault draw; pens that do nothing (ROP2 11) draw nothing. Pixels stand at whole
    numbers. Boxes of WMF leave out their right and bottom edge in device space, as that format has it, unless ``far_edges`` keeps them.
    """
    rows = decoded.join(played.filter("fault is null"), ["file", "seq"])
    f, c = F.col("fields"), F.col
    page = geometry.page_matrix((c("worg_x"), c("worg_y")), (c("wext_x"), c("wext_y")), (c("vorg_x"), c("vorg_y")), (c("vext_x"), c("vext_y")))

    def point(x, y):
        px, py = geometry.apply(page, x, y)
        return F.struct(px.alias("x"), py.alias("y"))

    name = F.regexp_replace("name", "(V|Ex)$", "")
    shape = F.when(name == "LineTo", "line").when(name == "SetPixel", "pixel").when(name.isin(*DRAWN[2:]), F.lower(name))
    line = F.array(point(c("x"), c("y")), point(f["x"], f["y"]))
    ends = point(f["left"], f["top"]), point(f["right"], f["bottom"])
    edge = F.when((F.col("format") == "WMF") & F.lit(not far_edges), 1.0).otherwise(0.0)
    corner = lambda pick, less: F.struct(*[(pick(ends[0][a], ends[1][a]) - less).alias(a) for a in "xy"])
    box = F.array(corner(F.least, F.lit(0.0)), corner(F.greatest, edge))
    at = point(f["x"], f["y"])
    pixel = F.struct(*[F.floor(at[a]).cast("double").alias(a) for a in "xy"])
    points = F.when(shape == "line", line).when(shape == "pixel", F.array(pixel)).otherwise(box)
    op = F.when(shape.isin("line", "arc"), "stroke").otherwise("fill")
    color = F.when(shape == "pixel", f["color"]).when(op == "stroke", c("pen")).otherwise(c("brush")).cast("long")
    drawn = rows.select("file", "seq", op.alias("op"), shape.alias("shape"), points.alias("points"), color.alias("color"), "rop2")
    return drawn.filter("shape is not null and (rop2 <> 11 or shape = 'pixel')").drop("rop2")


def reported(decoded: DataFrame, played: DataFrame) -> DataFrame:
    """``file, seq, name, reason``: records that failed, and those that neither draw nor change the context: none goes unsaid."""
    known = {"FloodFill": "flood fill", "ExtFloodFill": "flood fill", "InvertRegion": "region inversion reads the destination", "WidenPath": "path widening"}
    plain = F.regexp_replace("name", "(V|Ex)$", "")
    done = [*_SCALARS, *_PAIRS, *_CREATES, *_SILENT, *DRAWN, "SetMapMode", "OffsetWindowOrg", "OffsetViewportOrg", "MoveTo", "SaveDC", "RestoreDC", "SelectObject", "DeleteObject"]
    reason = F.coalesce(F.col("fault"), *[F.when(F.col("name") == n, F.lit(r)) for n, r in known.items()], F.when(F.col("name").isNull(), "unknown record"), F.when(~F.col("name").isin(done) & ~plain.isin(done), "not drawn"))
    return decoded.join(played.select("file", "seq", "fault"), ["file", "seq"]).withColumn("reason", reason).filter("reason is not null").select("file", "seq", "name", "reason")
