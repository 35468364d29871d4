"""Record names and the layouts of records of fixed size, by format and type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Record types of the published formats, with their fields from the first byte after the record's head.
# A field is name:kind; kinds are u8, i16, u16, i32, u32 and f32.
WMF = """
0x0000 EOF
0x001E SaveDC
0x0035 RealizePalette
0x0037 SetPaletteEntries start:u16 n:u16
0x00F7 CreatePalette start:u16 n:u16
0x0102 SetBkMode mode:u16
0x0103 SetMapMode mode:u16
0x0104 SetROP2 mode:u16
0x0105 SetRelAbs
0x0106 SetPolyFillMode mode:u16
0x0107 SetStretchBltMode mode:u16
0x0108 SetTextCharExtra extra:i16
0x0127 RestoreDC level:i16
0x012A InvertRegion region:u16
0x012B PaintRegion region:u16
0x012C SelectClipRegion region:u16
0x012D SelectObject object:u16
0x012E SetTextAlign mode:u16
0x0139 ResizePalette n:u16
0x0142 DIBCreatePatternBrush style:u16 usage:u16
0x0149 SetLayout layout:u16
0x01F0 DeleteObject object:u16
0x01F9 CreatePatternBrush
0x0201 SetBkColor color:u32
0x0209 SetTextColor color:u32
0x020A SetTextJustification count:u16 extra:u16
0x020B SetWindowOrg y:i16 x:i16
0x020C SetWindowExt y:i16 x:i16
0x020D SetViewportOrg y:i16 x:i16
0x020E SetViewportExt y:i16 x:i16
0x020F OffsetWindowOrg y:i16 x:i16
0x0211 OffsetViewportOrg y:i16 x:i16
0x0213 LineTo y:i16 x:i16
0x0214 MoveTo y:i16 x:i16
0x0220 OffsetClipRgn y:i16 x:i16
0x0228 FillRegion region:u16 brush:u16
0x0231 SetMapperFlags flags:u32
0x0234 SelectPalette palette:u16
0x02FA CreatePenIndirect style:u16 width:i16 height:i16 color:u32
0x02FB CreateFontIndirect height:i16 width:i16 escapement:i16 orientation:i16 weight:i16 italic:u8 underline:u8 strikeout:u8 charset:u8 outprecision:u8 clipprecision:u8 quality:u8 pitch:u8
0x02FC CreateBrushIndirect style:u16 color:u32 hatch:u16
0x0324 Polygon n:i16
0x0325 Polyline n:i16
0x0410 ScaleWindowExt ydenom:i16 ynum:i16 xdenom:i16 xnum:i16
0x0412 ScaleViewportExt ydenom:i16 ynum:i16 xdenom:i16 xnum:i16
0x0415 ExcludeClipRect bottom:i16 right:i16 top:i16 left:i16
0x0416 IntersectClipRect bottom:i16 right:i16 top:i16 left:i16
0x0418 Ellipse bottom:i16 right:i16 top:i16 left:i16
0x0419 FloodFill color:u32 y:i16 x:i16
0x041B Rectangle bottom:i16 right:i16 top:i16 left:i16
0x041F SetPixel color:u32 y:i16 x:i16
0x0429 FrameRegion region:u16 brush:u16 height:i16 width:i16
0x0436 AnimatePalette start:u16 n:u16
0x0521 TextOut length:i16
0x0538 PolyPolygon n:u16
0x0548 ExtFloodFill mode:u16 color:u32 y:i16 x:i16
0x061C RoundRect height:i16 width:i16 bottom:i16 right:i16 top:i16 left:i16
0x061D PatBlt rop:u32 height:i16 width:i16 y:i16 x:i16
0x0626 Escape function:u16 bytes:u16
0x06FF CreateRegion next:i16 kind:i16 objects:i32 bytes:i16 scans:i16 longest:i16 left:i16 top:i16 right:i16 bottom:i16
0x0817 Arc yend:i16 xend:i16 ystart:i16 xstart:i16 bottom:i16 right:i16 top:i16 left:i16
0x081A Pie yend:i16 xend:i16 ystart:i16 xstart:i16 bottom:i16 right:i16 top:i16 left:i16
0x0830 Chord yend:i16 xend:i16 ystart:i16 xstart:i16 bottom:i16 right:i16 top:i16 left:i16
0x0922 BitBlt rop:u32 ysrc:i16 xsrc:i16 height:i16 width:i16 y:i16 x:i16
0x0940 DIBBitBlt rop:u32 ysrc:i16 xsrc:i16 height:i16 width:i16 y:i16 x:i16
0x0A32 ExtTextOut y:i16 x:i16 length:i16 options:u16
0x0B23 StretchBlt rop:u32 hsrc:i16 wsrc:i16 ysrc:i16 xsrc:i16 height:i16 width:i16 y:i16 x:i16
0x0B41 DIBStretchBlt rop:u32 hsrc:i16 wsrc:i16 ysrc:i16 xsrc:i16 height:i16 width:i16 y:i16 x:i16
0x0D33 SetDIBToDev usage:u16 scans:u16 start:u16 ysrc:u16 xsrc:u16 height:u16 width:u16 y:u16 x:u16
0x0F43 StretchDIB rop:u32 usage:u16 hsrc:i16 wsrc:i16 ysrc:i16 xsrc:i16 height:i16 width:i16 y:i16 x:i16
"""

# The same records in their form without a bitmap, whose size in words is the function's high byte and three.
WMF_BARE = """
0x0922 BitBlt rop:u32 ysrc:i16 xsrc:i16 reserved:u16 height:i16 width:i16 y:i16 x:i16
0x0940 DIBBitBlt rop:u32 ysrc:i16 xsrc:i16 reserved:u16 height:i16 width:i16 y:i16 x:i16
0x0B23 StretchBlt rop:u32 hsrc:i16 wsrc:i16 ysrc:i16 xsrc:i16 reserved:u16 height:i16 width:i16 y:i16 x:i16
0x0B41 DIBStretchBlt rop:u32 hsrc:i16 wsrc:i16 ysrc:i16 xsrc:i16 reserved:u16 height:i16 width:i16 y:i16 x:i16
"""

EMF = """
1 Header left:i32 top:i32 right:i32 bottom:i32 fleft:i32 ftop:i32 fright:i32 fbottom:i32
2 PolyBezier left:i32 top:i32 right:i32 bottom:i32 n:u32
3 Polygon left:i32 top:i32 right:i32 bottom:i32 n:u32
4 Polyline left:i32 top:i32 right:i32 bottom:i32 n:u32
5 PolyBezierTo left:i32 top:i32 right:i32 bottom:i32 n:u32
6 PolylineTo left:i32 top:i32 right:i32 bottom:i32 n:u32
7 PolyPolyline left:i32 top:i32 right:i32 bottom:i32 groups:u32 n:u32
8 PolyPolygon left:i32 top:i32 right:i32 bottom:i32 groups:u32 n:u32
9 SetWindowExtEx x:i32 y:i32
10 SetWindowOrgEx x:i32 y:i32
11 SetViewportExtEx x:i32 y:i32
12 SetViewportOrgEx x:i32 y:i32
13 SetBrushOrgEx x:i32 y:i32
14 EOF
15 SetPixelV x:i32 y:i32 color:u32
16 SetMapperFlags flags:u32
17 SetMapMode mode:u32
18 SetBkMode mode:u32
19 SetPolyFillMode mode:u32
20 SetROP2 mode:u32
21 SetStretchBltMode mode:u32
22 SetTextAlign mode:u32
23 SetColorAdjustment size:u16 flags:u16 illuminant:u16 redgamma:u16 greengamma:u16 bluegamma:u16 black:u16 white:u16 contrast:i16 brightness:i16 colourfulness:i16 tint:i16
24 SetTextColor color:u32
25 SetBkColor color:u32
26 OffsetClipRgn x:i32 y:i32
27 MoveToEx x:i32 y:i32
28 SetMetaRgn
29 ExcludeClipRect left:i32 top:i32 right:i32 bottom:i32
30 IntersectClipRect left:i32 top:i32 right:i32 bottom:i32
31 ScaleViewportExtEx xnum:i32 xdenom:i32 ynum:i32 ydenom:i32
32 ScaleWindowExtEx xnum:i32 xdenom:i32 ynum:i32 ydenom:i32
33 SaveDC
34 RestoreDC level:i32
35 SetWorldTransform m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32
36 ModifyWorldTransform m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 mode:u32
37 SelectObject object:u32
38 CreatePen object:u32 style:u32 width:i32 unused:i32 color:u32
39 CreateBrushIndirect object:u32 style:u32 color:u32 hatch:u32
40 DeleteObject object:u32
41 AngleArc x:i32 y:i32 radius:u32 start:f32 sweep:f32
42 Ellipse left:i32 top:i32 right:i32 bottom:i32
43 Rectangle left:i32 top:i32 right:i32 bottom:i32
44 RoundRect left:i32 top:i32 right:i32 bottom:i32 width:i32 height:i32
45 Arc left:i32 top:i32 right:i32 bottom:i32 xstart:i32 ystart:i32 xend:i32 yend:i32
46 Chord left:i32 top:i32 right:i32 bottom:i32 xstart:i32 ystart:i32 xend:i32 yend:i32
47 Pie left:i32 top:i32 right:i32 bottom:i32 xstart:i32 ystart:i32 xend:i32 yend:i32
48 SelectPalette palette:u32
49 CreatePalette palette:u32 version:u16 n:u16
50 SetPaletteEntries palette:u32 start:u32 n:u32
51 ResizePalette palette:u32 n:u32
52 RealizePalette
53 ExtFloodFill x:i32 y:i32 color:u32 mode:u32
54 LineTo x:i32 y:i32
55 ArcTo left:i32 top:i32 right:i32 bottom:i32 xstart:i32 ystart:i32 xend:i32 yend:i32
56 PolyDraw left:i32 top:i32 right:i32 bottom:i32 n:u32
57 SetArcDirection direction:u32
58 SetMiterLimit limit:f32
59 BeginPath
60 EndPath
61 CloseFigure
62 FillPath left:i32 top:i32 right:i32 bottom:i32
63 StrokeAndFillPath left:i32 top:i32 right:i32 bottom:i32
64 StrokePath left:i32 top:i32 right:i32 bottom:i32
65 FlattenPath
66 WidenPath
67 SelectClipPath mode:u32
68 AbortPath
70 Comment
71 FillRgn left:i32 top:i32 right:i32 bottom:i32 bytes:u32 brush:u32
72 FrameRgn left:i32 top:i32 right:i32 bottom:i32 bytes:u32 brush:u32 width:i32 height:i32
73 InvertRgn left:i32 top:i32 right:i32 bottom:i32 bytes:u32
74 PaintRgn left:i32 top:i32 right:i32 bottom:i32 bytes:u32
75 ExtSelectClipRgn bytes:u32 mode:u32
76 BitBlt left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 width:i32 height:i32 rop:u32 xsrc:i32 ysrc:i32 m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 bkcolor:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32
77 StretchBlt left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 width:i32 height:i32 rop:u32 xsrc:i32 ysrc:i32 m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 bkcolor:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 wsrc:i32 hsrc:i32
78 MaskBlt left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 width:i32 height:i32 rop:u32 xsrc:i32 ysrc:i32 m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 bkcolor:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 xmask:i32 ymask:i32 maskusage:u32 maskbmi:u32 maskbmibytes:u32 maskbits:u32 maskbitbytes:u32
79 PlgBlt left:i32 top:i32 right:i32 bottom:i32 x0:i32 y0:i32 x1:i32 y1:i32 x2:i32 y2:i32 xsrc:i32 ysrc:i32 wsrc:i32 hsrc:i32 m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 bkcolor:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 xmask:i32 ymask:i32 maskusage:u32 maskbmi:u32 maskbmibytes:u32 maskbits:u32 maskbitbytes:u32
80 SetDIBitsToDevice left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 xsrc:i32 ysrc:i32 wsrc:i32 hsrc:i32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 usage:u32 start:u32 scans:u32
81 StretchDIBits left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 xsrc:i32 ysrc:i32 wsrc:i32 hsrc:i32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 usage:u32 rop:u32 width:i32 height:i32
82 ExtCreateFontIndirectW object:u32 height:i32 width:i32 escapement:i32 orientation:i32 weight:i32 italic:u8 underline:u8 strikeout:u8 charset:u8 outprecision:u8 clipprecision:u8 quality:u8 pitch:u8
83 ExtTextOutA left:i32 top:i32 right:i32 bottom:i32 mode:u32 xscale:f32 yscale:f32 x:i32 y:i32 length:u32 text:u32 options:u32 cleft:i32 ctop:i32 cright:i32 cbottom:i32 advances:u32
84 ExtTextOutW left:i32 top:i32 right:i32 bottom:i32 mode:u32 xscale:f32 yscale:f32 x:i32 y:i32 length:u32 text:u32 options:u32 cleft:i32 ctop:i32 cright:i32 cbottom:i32 advances:u32
85 PolyBezier16 left:i32 top:i32 right:i32 bottom:i32 n:u32
86 Polygon16 left:i32 top:i32 right:i32 bottom:i32 n:u32
87 Polyline16 left:i32 top:i32 right:i32 bottom:i32 n:u32
88 PolyBezierTo16 left:i32 top:i32 right:i32 bottom:i32 n:u32
89 PolylineTo16 left:i32 top:i32 right:i32 bottom:i32 n:u32
90 PolyPolyline16 left:i32 top:i32 right:i32 bottom:i32 groups:u32 n:u32
91 PolyPolygon16 left:i32 top:i32 right:i32 bottom:i32 groups:u32 n:u32
92 PolyDraw16 left:i32 top:i32 right:i32 bottom:i32 n:u32
93 CreateMonoBrush object:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32
94 CreateDIBPatternBrushPt object:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32
95 ExtCreatePen object:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 style:u32 width:u32 brushstyle:u32 color:u32 hatch:u32 n:u32
96 PolyTextOutA left:i32 top:i32 right:i32 bottom:i32 mode:u32 xscale:f32 yscale:f32 n:u32
97 PolyTextOutW left:i32 top:i32 right:i32 bottom:i32 mode:u32 xscale:f32 yscale:f32 n:u32
98 SetICMMode mode:u32
99 CreateColorSpace object:u32
100 SetColorSpace object:u32
101 DeleteColorSpace object:u32
102 GLSRecord bytes:u32
103 GLSBoundedRecord left:i32 top:i32 right:i32 bottom:i32 bytes:u32
104 PixelFormat size:u16 version:u16 flags:u32
105 DrawEscape escape:u32 bytes:u32
106 ExtEscape escape:u32 bytes:u32
108 SmallTextOut x:i32 y:i32 length:u32 options:u32 mode:u32 xscale:f32 yscale:f32
109 ForceUFIMapping checksum:u32 index:u32
110 NamedEscape escape:u32 driver:u32 bytes:u32
111 ColorCorrectPalette palette:u32 first:u32 n:u32 unused:u32
112 SetICMProfileA flags:u32 namebytes:u32 bytes:u32
113 SetICMProfileW flags:u32 namebytes:u32 bytes:u32
114 AlphaBlend left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 width:i32 height:i32 blend:u32 xsrc:i32 ysrc:i32 m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 bkcolor:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 wsrc:i32 hsrc:i32
115 SetLayout layout:u32
116 TransparentBlt left:i32 top:i32 right:i32 bottom:i32 x:i32 y:i32 width:i32 height:i32 color:u32 xsrc:i32 ysrc:i32 m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32 bkcolor:u32 usage:u32 bmi:u32 bmibytes:u32 bits:u32 bitbytes:u32 wsrc:i32 hsrc:i32
118 GradientFill left:i32 top:i32 right:i32 bottom:i32 vertices:u32 shapes:u32 mode:u32
119 SetLinkedUFIs n:u32
120 SetTextJustification extra:i32 count:i32
121 ColorMatchToTargetW action:u32 flags:u32 namebytes:u32 bytes:u32
122 CreateColorSpaceW object:u32
"""

EMFPLUS = """
0x4001 Header version:u32 flags:u32 dpix:u32 dpiy:u32
0x4002 EndOfFile
0x4003 Comment
0x4004 GetDC
0x4008 Object
0x4009 Clear color:u32
0x400A FillRects brush:u32 n:u32
0x400B DrawRects n:u32
0x400C FillPolygon brush:u32 n:u32
0x400D DrawLines n:u32
0x400E FillEllipse brush:u32
0x400F DrawEllipse
0x4010 FillPie brush:u32 start:f32 sweep:f32
0x4011 DrawPie start:f32 sweep:f32
0x4012 DrawArc start:f32 sweep:f32
0x4013 FillRegion brush:u32
0x4014 FillPath brush:u32
0x4015 DrawPath pen:u32
0x4016 FillClosedCurve brush:u32 tension:f32 n:u32
0x4017 DrawClosedCurve tension:f32 n:u32
0x4018 DrawCurve tension:f32 offset:u32 segments:u32 n:u32
0x4019 DrawBeziers n:u32
0x401A DrawImage attributes:u32 unit:i32 sx:f32 sy:f32 sw:f32 sh:f32
0x401B DrawImagePoints attributes:u32 unit:i32 sx:f32 sy:f32 sw:f32 sh:f32 n:u32
0x401C DrawString brush:u32 format:u32 length:u32 x:f32 y:f32 width:f32 height:f32
0x401D SetRenderingOrigin x:i32 y:i32
0x401E SetAntiAliasMode
0x401F SetTextRenderingHint
0x4020 SetTextContrast
0x4021 SetInterpolationMode
0x4022 SetPixelOffsetMode
0x4023 SetCompositingMode
0x4024 SetCompositingQuality
0x4025 Save index:u32
0x4026 Restore index:u32
0x4027 BeginContainer dx:f32 dy:f32 dw:f32 dh:f32 sx:f32 sy:f32 sw:f32 sh:f32 index:u32
0x4028 BeginContainerNoParams index:u32
0x4029 EndContainer index:u32
0x402A SetWorldTransform m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32
0x402B ResetWorldTransform
0x402C MultiplyWorldTransform m11:f32 m12:f32 m21:f32 m22:f32 dx:f32 dy:f32
0x402D TranslateWorldTransform dx:f32 dy:f32
0x402E ScaleWorldTransform sx:f32 sy:f32
0x402F RotateWorldTransform angle:f32
0x4030 SetPageTransform scale:f32
0x4031 ResetClip
0x4032 SetClipRect x:f32 y:f32 width:f32 height:f32
0x4033 SetClipPath
0x4034 SetClipRegion
0x4035 OffsetClip dx:f32 dy:f32
0x4036 DrawDriverString brush:u32 options:u32 matrix:u32 n:u32
0x4037 StrokeFillPath brush:u32
0x4038 SerializableObject guid1:u32 guid2:u32 guid3:u32 guid4:u32 bytes:u32
0x4039 SetTSGraphics modes:u32 xorigin:i16 yorigin:i16 contrast:u16
0x403A SetTSClip
"""

#: Bytes before the body: size and function; type and size; type, flags, size and data size.
HEADS = {"WMF": 6, "EMF": 8, "EMF+": 12}
_SIZES = {"u8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "f32": 4}


def _placed(form: str, text: str) -> list[tuple]:
    out = []
    for line in text.strip().splitlines():
        code, name, *fields = line.split()
        at, listed = HEADS[form], []
        for field in fields:
            label, kind = field.split(":")
            listed.append((label, kind, at))
            at += _SIZES[kind]
        out.append((form, int(code, 0), name, listed))
    return out


def layout_rows() -> list[tuple]:
    """(format, type, name, fields) with each field's offset in the record."""
    return [row for form, text in (("WMF", WMF), ("EMF", EMF), ("EMF+", EMFPLUS)) for row in _placed(form, text)]


class _Decoder:
    """Names and fields of records, a batch at a time: the values of one field of all records of a type are read at once."""

    def __init__(self, form: int, kind: int, raw: int, names: list[str]):
        self.at, self.names = (form, kind, raw), names
        rows, bare = layout_rows(), {code: fields for _, code, _, fields in _placed("WMF", WMF_BARE)}
        self.layouts = [(name, fields) for *_, name, fields in rows]
        self.ids = {(form, code % 256 if form == "WMF" else code): k for k, (form, code, *_) in enumerate(rows)}
        self.bare = {}
        for k, (form, code, name, _) in enumerate(rows):
            if form == "WMF" and code in bare:
                self.bare[k] = len(self.layouts)
                self.layouts.append((name, bare[code]))
        self.labels = sorted({label for _, fields in self.layouts for label, *_ in fields})
        self.places = {label: k for k, label in enumerate(self.labels)}

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, kind, raw = (batch.column(k) for k in self.at)
            ids = self.types(form, kind, raw)
            name = pa.array([n for n, _ in self.layouts]).take(pa.array(ids, mask=ids < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, name, self.fields(ids, raw)], names=self.names)

    def types(self, form: pa.Array, kind: pa.Array, raw: pa.Array) -> np.ndarray:
        """The number of each record's layout; -1 for unknown types."""
        known = ~np.asarray(pc.is_null(kind)) & ~np.asarray(pc.is_null(form))
        code, ids = np.asarray(pc.fill_null(kind, 0)).astype("int64"), np.full(len(kind), -1)
        for name in pc.unique(form).to_pylist():
            mine = known & np.asarray(pc.fill_null(pc.equal(form, name), False)) if name is not None else np.zeros(len(kind), bool)
            codes, which = np.unique(np.fmod(code[mine], 256) if name == "WMF" else code[mine], return_inverse=True)
            ids[mine] = np.array([self.ids.get((name, c), -1) for c in codes.tolist()], "int64")[which]
        fits = np.asarray(pc.fill_null(pc.binary_length(raw), -1)) == 2 * ((code >> 8) + 3)
        for k, other in self.bare.items():
            ids[(ids == k) & fits] = other
        return ids

    def fields(self, ids: np.ndarray, raw: pa.Array) -> pa.MapArray:
        sizes = np.asarray(pc.fill_null(pc.binary_length(raw), 0)).astype("int64")
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(v.as_buffer() for v in raw if v.is_valid) + bytes(4), "uint8")
        counts = np.where(ids < 0, 0, np.array([len(f) for _, f in self.layouts])[ids])
        ends = np.cumsum(counts)
        keys, values, none = np.zeros(ends[-1] if len(ends) else 0, "int32"), np.zeros(ends[-1] if len(ends) else 0), np.zeros(ends[-1] if len(ends) else 0, bool)
        order = np.argsort(ids, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
            if not len(part) or ids[part[0]] < 0:
                continue
            for j, (label, kind, at) in enumerate(self.layouts[ids[part[0]]][1]):
                to, size = ends[part] - counts[part] + j, _SIZES[kind]
                inside = sizes[part] >= at + size
                place = np.where(inside, starts[part] + at, 0)
                bytes_ = np.stack([data[place + k] for k in range(size)], axis=1)
                value = bytes_.view(f"<{kind[0]}{size}").ravel().astype("float64")
                keys[to], values[to], none[to] = self.places[label], value, ~inside | ~np.isfinite(value)
        offsets = pa.array(np.append(0, ends).astype("int32"), mask=np.append(ids < 0, False))
        return pa.MapArray.from_arrays(offsets, pa.array(self.labels).take(pa.array(keys)), pa.array(values, mask=none))


def decode(records: DataFrame) -> DataFrame:
    """Adds ``name`` and ``fields`` (map of double) to records; null where the type is unknown, no fields where none are fixed.

    WMF types are told by their low byte, as writers vary the parameter count in the high byte; their transfers have another
    layout where the record's size leaves no place for a bitmap. A field beyond the end of the record is null.
    """
    kind = StructType([*records.schema.fields, *StructType.fromDDL("name string, fields map<string, double>").fields])
    return records.mapInArrow(_Decoder(*[records.columns.index(c) for c in ("format", "type", "raw")], kind.names).run, kind)


#: (format, names, test of the fields, fault): what the decoder refuses beyond sizes.
RANGES = [
    ("WMF", ("ScaleWindowExt", "ScaleViewportExt"), lambda f: (f["xdenom"] == 0) | (f["ydenom"] == 0), "zero scale denominator"),
    ("WMF", ("Polygon",), lambda f: f["n"] < 2, "point count"),
    ("WMF", ("Polyline",), lambda f: f["n"] < 0, "point count"),
    ("WMF", ("TextOut", "ExtTextOut"), lambda f: f["length"] < 0, "text length"),
    ("WMF", ("ExtFloodFill",), lambda f: f["mode"] > 1, "flood fill mode"),
    ("WMF", ("CreatePalette",), lambda f: f["start"] != 0x300, "palette version"),
    ("WMF", ("RestoreDC",), lambda f: f["level"] == 0, "restore level"),
    ("EMF", ("RestoreDC",), lambda f: f["level"] >= 0, "restore level"),
    ("EMF", ("ScaleWindowExtEx", "ScaleViewportExtEx"), lambda f: (f["xnum"] == 0) | (f["xdenom"] == 0) | (f["ynum"] == 0) | (f["ydenom"] == 0), "zero scale factor"),
    ("EMF", ("ModifyWorldTransform",), lambda f: ~f["mode"].between(1, 4), "world transform mode"),
    ("EMF", ("CreatePalette",), lambda f: f["version"] != 0x300, "palette version"),
    ("EMF", ("ResizePalette",), lambda f: ~f["n"].between(1, 1024), "palette size"),
    ("EMF", ("ExtFloodFill",), lambda f: f["mode"] > 1, "flood fill mode"),
    ("EMF", ("PolyBezier", "PolyBezier16"), lambda f: (f["n"] < 4) | ((f["n"] - 1) % 3 != 0), "Bezier point count"),
    ("EMF", ("PolyBezierTo", "PolyBezierTo16"), lambda f: (f["n"] == 0) | (f["n"] % 3 != 0), "Bezier point count"),
    ("EMF", ("ExtSelectClipRgn",), lambda f: ~f["mode"].between(1, 5) | ((f["bytes"] == 0) & (f["mode"] != 5)), "region mode"),
    ("EMF", ("AlphaBlend",), lambda f: (f["blend"] % 256 != 0) | (F.floor(f["blend"] / (1 << 24)) > 1) | (f["width"] <= 0) | (f["height"] <= 0) | (f["wsrc"] <= 0) | (f["hsrc"] <= 0), "alpha blend parameters"),
]

#: EMF+ types that stand in the format's list but in no file.
RESERVED = (0x4005, 0x4006, 0x4007)


def range_faults(decoded: DataFrame) -> DataFrame:
    """Adds ``fault`` to decoded records: what is wrong with a value, or a reserved type; null where nothing is."""
    f, fault = F.col("fields"), F.when((F.col("format") == "EMF+") & F.col("type").isin(*RESERVED), "reserved type")
    for form, names, test, said in RANGES:
        fault = fault.when((F.col("format") == form) & F.col("name").isin(*names) & F.coalesce(test(f), F.lit(False)), said)
    return decoded.withColumn("fault", fault)
