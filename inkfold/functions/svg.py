"""SVG documents: minifying, baking of transforms, simplifying, repair. Plain functions with a column form below."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions import paths
from inkfold.functions.numbers import rounded_text

NAMESPACE = "http://www.w3.org/2000/svg"
XLINK = "http://www.w3.org/1999/xlink"
# Fixed value: the only form of transform that is baked in.
_MOVE_AND_SCALE = re.compile(r"\s*translate\(([-+]?\d*\.?\d+)\s+([-+]?\d*\.?\d+)\)\s+scale\(([-+]?\d*\.?\d+)\s+([-+]?\d*\.?\d+)\)\s*")
#: A whole ``d`` or ``transform`` attribute, or a stretch of anything else.
_STRETCH = r"""(?s)(?<![\w:-])(?:d|transform)=(?:"[^"]*"|'[^']*')|[^dt]+|[dt]"""


def _quoted(attribute: Column, change: Callable[[Column], Column]) -> Column:
    """An attribute with its value changed; its name and quotes stay."""
    name = F.regexp_extract(attribute, r"""^[a-z]+=["']""", 0)
    return F.concat(name, change(F.substr(attribute, F.length(name) + 1, F.length(attribute) - F.length(name) - 1)), F.right(name, F.lit(1)))


def _numbers(text: Column, decimals: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({paths.NUMBER})")), lambda x: rounded_text(x, decimals))


def minify_path(data: Column, decimals: int = 0) -> Column:
    """Path data without blanks, numbers rounded half up, commas only between numbers."""
    read = F.regexp_extract_all(data, F.lit(rf"([{paths.LETTERS}]|{paths.NUMBER})"))
    short = F.transform(read, lambda x: F.coalesce(rounded_text(x, decimals), x))
    return F.regexp_replace(F.array_join(short, ","), f",?([{paths.LETTERS}]),?", "$1")


def minify_transform(text: Column, decimals: int = 0, tight: bool = False) -> Column:
    """A transform with rounded numbers and commas; ``tight`` drops the blanks between functions, too."""
    parts = F.regexp_extract_all(text, F.lit(r"(\([^()]*\)|[^()]+|[()])"))
    short = F.transform(parts, lambda x: F.when(x.startswith("(") & x.endswith(")"), F.concat(F.lit("("), F.array_join(_numbers(x, decimals), ","), F.lit(")"))).otherwise(x))
    joined = F.regexp_replace(F.array_join(short, ""), r"^\s+|\s+$", "")
    return F.replace(joined, F.lit(" "), F.lit("")) if tight else joined


def minify(svg: Column, decimals: int = 0) -> Column:
    """All ``d`` and ``transform`` attributes minified, blanks between tags dropped; quotes stay. Other attributes that end in d are left
    alone. A fold over stretches of the text, in Spark's own expressions; null gives null."""
    data = lambda x: minify_path(x, decimals)
    moves = lambda x: minify_transform(x, decimals)
    short = F.transform(F.regexp_extract_all(svg, F.lit(f"({_STRETCH})")), lambda x: F.when(x.rlike("""^d=["']"""), _quoted(x, data)).when(x.rlike("""^transform=["']"""), _quoted(x, moves)).otherwise(x))
    return F.regexp_replace(F.array_join(short, ""), r">\s+<", "><")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _steps(element: ET.Element) -> Sequence[paths.Step]:
    steps = paths.parse(element.get("d", ""))
    return paths.moved(steps, paths.transform_matrix(element.get("transform"))) if element.get("transform") else steps


def bounding_box(svg: str) -> tuple[float, float, float, float] | None:
    """``(x, y, width, height)`` of all paths of a document under their own transforms; None if nothing is drawn."""
    drawn = (e for e in ET.fromstring(svg).iter() if _local(e.tag) == "path")
    return paths.joined(paths.box(_steps(e)) if e.get("transform") else paths.extent_of(e.get("d", "")) for e in drawn)


def _serialised(root: ET.Element) -> str:
    ET.register_namespace("", NAMESPACE)
    ET.register_namespace("xlink", XLINK)
    return ET.tostring(root, encoding="unicode")


def bake(svg: str, *, scale: bool = True, translate: bool = True, relative: bool = True) -> str:
    """Transforms of the form ``translate(x y) scale(x y)`` worked into the paths, and a viewBox that fits.

    Either part can be left in the attribute, but not the scale alone: baking a shift before its scale would move the drawing.
    Paths with another transform or none keep theirs.
    """
    if translate and not scale:
        raise ValueError("a shift can't be baked in without the scale that comes after it")
    root = ET.fromstring(svg)
    for e in root.iter():
        found = _MOVE_AND_SCALE.fullmatch(e.get("transform", "")) if _local(e.tag) == "path" else None
        if not found:
            continue
        parts = {f"translate({found[1]} {found[2]})": translate, f"scale({found[3]} {found[4]})": scale}
        steps = paths.moved(paths.parse(e.get("d", "")), paths.transform_matrix(" ".join(p for p, now in parts.items() if now)))
        e.set("d", paths.written(steps, relative))
        left = " ".join(p for p, now in parts.items() if not now)
        if left:
            e.set("transform", left)
        else:
            del e.attrib["transform"]
    size = paths.box([s for e in root.iter() if _local(e.tag) == "path" for s in _steps(e)])
    if size:
        root.set("viewBox", " ".join(f"{x:g}" for x in size))
    return _serialised(root)


def _rgb(colour: str | None) -> tuple[int, ...] | None:
    found = re.fullmatch(r"#?([0-9A-Fa-f]{6})", colour or "")
    return tuple(bytes.fromhex(found[1])) if found else None


def _first_stops(root: ET.Element) -> dict[str, str]:
    """The first stop colour of each gradient, through references; gradients without one are left out."""
    found = {e.get("id"): e for e in root.iter() if _local(e.tag) in ("linearGradient", "radialGradient") and e.get("id")}

    def colour(name: str | None, seen: frozenset = frozenset()) -> str | None:
        if name not in found or name in seen:
            return None
        stop = next((s.get("stop-color") for s in found[name].iter() if _local(s.tag) == "stop" and s.get("stop-color")), None)
        return stop or colour((found[name].get(f"{{{XLINK}}}href") or found[name].get("href") or "#")[1:], seen | {name})

    return {name: c for name in found if (c := colour(name))}


def encode(svg: str, empty_fill: str = "previous") -> str:
    """A document as one element a line: gradients become their first colour, groups hand their attributes down, the root goes.

    ``empty_fill``: a path without fill gets the mean of the fills before it (``previous``), stays as it is (``skip``) or
    is black (``default``). Text that isn't an SVG document is returned as it is.
    """
    root = ET.fromstring(svg)
    if root.tag != f"{{{NAMESPACE}}}svg":
        return svg
    stops, fills = _first_stops(root), []
    for path in (e for e in root.iter() if _local(e.tag) == "path"):
        fill = path.get("fill")
        if fill and (found := re.fullmatch(r"url\(#(.*)\)", fill)) and found[1] in stops:
            path.set("fill", stops[found[1]])
        elif fill is None and empty_fill == "previous" and fills:
            path.set("fill", "#" + "".join(f"{sum(c[k] for c in fills) // len(fills):02x}" for k in range(3)))
        elif fill is None and empty_fill == "default":
            path.set("fill", "#000000")
        if colour := _rgb(path.get("fill")):
            fills.append(colour)

    def flat(parent: ET.Element, inherited: dict[str, str]) -> list[ET.Element]:
        out = []
        for e in list(parent):
            kind = _local(e.tag)
            if kind in ("linearGradient", "radialGradient"):
                continue
            for name, value in inherited.items():
                e.attrib.setdefault(name, value)
            if kind == "g":
                out += flat(e, dict(e.attrib))
                continue
            if kind == "defs":
                e[:] = [x for x in e if _local(x.tag) not in ("linearGradient", "radialGradient")]
                if not len(e):
                    continue
            out.append(e)
        return out

    lines = []
    for e in flat(root, {}):
        for x in e.iter():
            x.tag = _local(x.tag)
        e.tail = None
        lines.append(ET.tostring(e, encoding="unicode").replace(" />", "/>") + "\n")
    return "".join(lines)


_ELEMENT = re.compile(r"""\s*<(/?)([A-Za-z][\w:.-]*)((?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(/?)>\s*""")
_OPEN_DATA = re.compile(r"""\s*<path((?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s+d\s*=\s*"([^"<>]*)$""")


def repaired(text: str) -> str:
    """The longest beginning of simplified SVG that is well formed, what precedes the first path cut off.

    A last path that is cut off within its data is closed after its last whole command. One pass: elements are read
    one by one, and the end of the last point at which all are closed is kept.
    """
    start = text.find("<path")
    text = text[start:] if start >= 0 else text
    at = good = 0
    open_: list[str] = []
    while found := _ELEMENT.match(text, at):
        closing, name, _, empty = found.groups()
        if closing:
            if not open_ or open_.pop() != name:
                break
        elif not empty:
            open_.append(name)
        at = found.end()
        if not open_:
            good = at
    out = text[:good]
    if not open_ and (found := _OPEN_DATA.match(text, at)):
        steps = paths.parse(found[2])
        whole = found[2].rstrip()
        tail = re.search(r"[A-Za-z][^A-Za-z]*$", whole)
        if steps and tail:
            kind = tail[0][0].upper()
            numbers = len(re.findall(paths.NUMBER, tail[0]))
            take = paths.TAKES.get(kind, 1)
            complete = not take or numbers and numbers % take == 0
            data = whole if complete else whole[: tail.start()]
            if data.strip():
                out += f'<path{found[1]} d="{data.strip()}"/>\n'
    return out


def _document(lines: str, size: Sequence[float] | None = None) -> str:
    box = f' viewBox="{" ".join(f"{x:g}" for x in size)}"' if size else ""
    return f'<svg xmlns="{NAMESPACE}"{box}>\n{lines}</svg>'


def decode(text: str) -> str:
    """Simplified SVG as a document, repaired, with a viewBox that fits if anything is drawn."""
    inside = repaired(text)
    return _document(inside, bounding_box(_document(inside)))


_FLAT = re.compile(r"""(?:<path(?: [\w.-]+="[^"<>&\t\r\n]*")*/>\n)*""")


def sound(lines: str) -> bool:
    """Whether an encoding is what its decoding is encoded to. An encoding has no root, so no viewBox is worked out. Lines of paths alone, all
    filled or none, with nothing to escape, are read and written as they stand."""
    if _FLAT.fullmatch(lines) and lines.count(' fill="') in (0, lines.count("\n")):
        return True
    return encode(_document(repaired(lines))) == lines


def points(svg: str, n: int, per_path: bool = False) -> list[list[float]]:
    """``n`` points at equal arc length over all paths of a document (or over each path)."""
    drawn = [_steps(e) for e in ET.fromstring(svg).iter() if _local(e.tag) == "path"]
    if per_path:
        return [p for steps in drawn for p in paths.sampled(steps, n).tolist()]
    return paths.sampled([s for steps in drawn for s in steps], n).tolist()


def _column(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A column form: null gives null, and so does a text that ``f`` can't work on, as its own row's error only."""

    def one(text: str | None):
        if text is None:
            return None
        try:
            return f(text)
        except (ValueError, ET.ParseError, KeyError, IndexError, ZeroDivisionError):
            return None

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def bake_column(svg: Column, **options: bool) -> Column:
    return _column(lambda t: bake(t, **options), "string")(svg)


def box_column(svg: Column) -> Column:
    """``[x, y, width, height]``."""
    return _column(lambda t: (lambda b: list(b) if b else None)(bounding_box(t)), "array<double>")(svg)


def encode_column(svg: Column, empty_fill: str = "previous") -> Column:
    return _column(lambda t: encode(t, empty_fill), "string")(svg)


def decode_column(text: Column) -> Column:
    return _column(decode, "string")(text)


def points_column(svg: Column, n: int = 200, per_path: bool = False) -> Column:
    return _column(lambda t: points(t, n, per_path), "array<array<double>>")(svg)


def survives_coding(svg: Column) -> Column:
    """Whether encoding, decoding and encoding again gives the first encoding; false for texts that can't be read."""
    return F.coalesce(_column(lambda text: sound(encode(text)), "boolean")(svg), F.lit(False))


def coded_column(svg: Column) -> Column:
    """``<lines, sound>``: the encoding of a document and whether it survives decoding; nulls for documents that can't be read."""

    def code(text: str) -> dict:
        lines = encode(text)
        return {"lines": lines, "sound": sound(lines)}

    @F.pandas_udf("struct<lines: string, sound: boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> dict:
            try:
                return code(text) if text is not None else {"lines": None, "sound": None}
            except (ValueError, ET.ParseError, KeyError, IndexError, ZeroDivisionError):
                return {"lines": None, "sound": None}

        return pd.DataFrame([one(t) for t in texts], columns=["lines", "sound"])

    return run(svg)
