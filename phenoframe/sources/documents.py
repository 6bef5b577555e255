"""Root-geometry XML documents as axis tables, and back."""

from __future__ import annotations

import math
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.functions import text as ft
from phenoframe.schema import AXES

# Limits of an accepted document.
MAX_BYTES = 64 * 1024 * 1024
MAX_ELEMENTS = 1_000_000
MAX_DEPTH = 256


class Refusal(Exception):
    """Why a document is not read any further."""


class AxisStream:
    """Axis rows from one pass over the events of a document; no tree is kept.

    An element is known by where it stands: axes are an unbroken line of ``root`` elements below a plant of the first
    scene, so an element is the next axis when as many elements are open as there are open axes, plus rsml, scene and plant.
    What makes the content unusable is noted and told at the end, as a document may turn out not to be well-formed.
    """

    ABOVE = 3  # rsml, scene, plant
    TEXTS = {("metadata", "unit"): "unit", ("metadata", "resolution"): "resolution", ("metadata", "image", "name"): "image_name"}

    def __init__(self):
        self.open: list[str] = []
        self.line: list[int] = []  # numbers of the open axes, outermost first
        self.axes: list[dict] = []
        self.texts: dict[str, list[str]] = {}
        self.plant_ids: list[str] = []
        self.home = self.outermost = ""  # namespace and name of the document element
        self.seen = self.scenes = 0
        self.bad_point = False
        self.listening: list[str] | None = None

    def read(self, raw: bytes) -> None:
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self._enter, self._leave, self._hear
        parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = self._declared
        try:
            parser.Parse(raw, True)
        except expat.ExpatError:
            raise Refusal("not well-formed") from None

    def _declared(self, *_):
        raise Refusal("DTD or entity")

    def _enter(self, full: str, attributes: dict) -> None:
        space, _, name = full.rpartition(" ")
        if not self.seen:
            self.home, self.outermost = space, name
        self.seen += 1
        self.open.append(name if space == self.home else full)
        if len(self.open) > MAX_DEPTH or self.seen > MAX_ELEMENTS:
            raise Refusal("too complex")
        self.listening = None
        at = len(self.open)
        if at == 2:
            self.scenes += self.open[1] == "scene"
        if self.open[1:2] == ["scene"]:
            if self.scenes == 1:
                self._scene(at, self.open[-1], attributes)
        elif (label := self.TEXTS.get(tuple(self.open[1:]))) and label not in self.texts:
            self.listening = self.texts[label] = []

    def _scene(self, at: int, name: str, attributes: dict) -> None:
        if at == self.ABOVE:
            if name == "plant":
                self.plant_ids.append(attributes.get("id", ""))
        elif self.open[2:3] != ["plant"]:
            return
        elif name == "root" and at == self.ABOVE + len(self.line) + 1:
            above = self.line[-1] if self.line else None
            self.line.append(len(self.axes))
            self.axes.append({
                "root_index": len(self.axes), "parent_index": above, "plant_index": len(self.plant_ids) - 1, "plant_id": self.plant_ids[-1],
                "root_id": attributes.get("id", ""), "parent_id": None if above is None else self.axes[above]["root_id"], "points": []})
        elif self.line and at == self.ABOVE + len(self.line) + 3 and self.open[-3:] == ["geometry", "polyline", "point"]:
            self._point(self.axes[self.line[-1]]["points"], attributes)

    def _point(self, points: list[list[float]], attributes: dict) -> None:
        """Two or three finite numbers, as many as the axis' other points have."""
        texts = [attributes.get("x"), attributes.get("y"), *([attributes["z"]] if "z" in attributes else [])]
        try:
            place = [float(t) for t in texts]
        except (TypeError, ValueError):
            place = [math.nan]
        self.bad_point |= not all(map(math.isfinite, place)) or bool(points and len(points[0]) != len(place))
        points.append(place)

    def _leave(self, _: str) -> None:
        if self.line and len(self.open) == self.ABOVE + len(self.line):
            self.line.pop()
        self.open.pop()
        self.listening = None

    def _hear(self, text: str) -> None:
        if self.listening is not None:
            self.listening.append(text)

    def shared(self) -> dict:
        """What all axes of the document have in common."""
        if self.outermost != "rsml" or not self.scenes:
            raise Refusal("no scene")
        told = {label: "".join(parts) for label, parts in self.texts.items()}
        try:
            resolution = float(told.get("resolution", "1"))
        except ValueError:
            resolution = math.nan
        if not 0 < resolution < math.inf:
            raise Refusal("resolution")
        if self.bad_point:
            raise Refusal("invalid polyline")
        return {"n_plants": len(self.plant_ids), "unit": told.get("unit", "pixel"), "resolution": resolution, "image_name": told.get("image_name", "")}


def document_rows(path: str, raw: bytes) -> list[dict]:
    """Axis rows of one document in depth-first order, or one row with the reason of refusal."""
    stream = AxisStream()
    try:
        if len(raw) > MAX_BYTES:
            raise Refusal("too large")
        stream.read(raw)
        common = {"path": path, "reason": None} | stream.shared()
    except Refusal as why:
        return [{"path": path, "reason": str(why)}]
    return [common | axis for axis in stream.axes] or [common]


def parse_documents(files: DataFrame) -> DataFrame:
    """Axes of all documents in (path, content); refused documents keep one row with a reason.

    A document with plants but no axes keeps one row without root_index.
    """
    names = [f.name for f in AXES.fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, raw in zip(batch["path"], batch["content"]) for r in document_rows(path, bytes(raw))]
            frame = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
            for n in ("root_index", "parent_index", "plant_index", "n_plants"):
                frame[n] = frame[n].astype("Int32")
            yield frame

    return files.select("path", "content").mapInPandas(parse, AXES)


def read_documents(spark: SparkSession, folder: str, glob: str = "*.rsml") -> DataFrame:
    """Parse a folder; files over the size limit are refused from their length, unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    small = parse_documents(files.where(F.col("length") <= MAX_BYTES))
    large = files.where(F.col("length") > MAX_BYTES).select("path", F.lit("too large").alias("reason"))
    return small.unionByName(large, allowMissingColumns=True)


def accepted(axes: DataFrame) -> DataFrame:
    return axes.where("reason is null and root_index is not null")


def export_gate(points: DataFrame, images: DataFrame, keys) -> DataFrame:
    """Images whose pixels are null, not finite or outside the image; empty when all is well."""
    inside = (F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    return points.join(images.select(*keys, "width", "height"), list(keys), "left").groupBy(*keys).agg(
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_bad")
    ).where("n_bad > 0")


def _escape(column):
    c = F.regexp_replace(column, "&", "&amp;")
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.regexp_replace(c, raw, safe)
    return c


def geometry_lines(points: DataFrame, images: DataFrame, main: DataFrame | None = None) -> DataFrame:
    """(group_id, frame_no, line_no, value): XML lines of one document per image.

    ``points`` has group_id, frame_no, plant, path (any sortable id), pos, x, y; ``images`` has
    group_id, frame_no, file_name, date. Lines carry a sortable number and are never collected
    into one value, so a document may be arbitrarily long. An isolated pixel is written twice,
    giving a line of zero length. ``main`` marks main-axis pixels (group_id, frame_no, plant, x, y).
    """
    keys = ["group_id", "frame_no"]
    head = F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8'?><rsml><metadata><version>1</version><unit>pixel</unit><resolution>1</resolution>"),
        F.lit("<file-key>"), _escape(F.concat_ws("/", "group_id", "frame_no", "file_name")), F.lit("</file-key><image><name>"),
        _escape(F.col("file_name")), F.lit("</name><captured>"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("</captured></image><time-sequence><label>"), _escape(F.col("group_id")), F.lit("</label><index>"),
        F.col("frame_no").cast("string"), F.lit("</index><unified>false</unified></time-sequence></metadata><scene>"),
    )
    rank = ["plant", "path", "pos"]
    low, high = F.lit(-1).cast("long"), F.lit(2**62).cast("long")

    def line(df, plant, path, pos, step, value):
        return df.select(*keys, plant.alias("plant"), path.alias("path"), pos.alias("pos"), F.lit(step).alias("step"), value.alias("value"))

    plants = points.select(*keys, "plant").distinct()
    paths = points.groupBy(*keys, "plant", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), "pos").alias("p")
    )
    def node(p):
        return F.concat(F.lit('<point x="'), p["x"].cast("string"), F.lit('" y="'), p["y"].cast("string"), F.lit('"/>'))

    number = F.col("plant").cast("long")
    opened = F.concat(F.lit('<root id="p'), number.cast("string"), F.lit("-"), F.col("path").cast("string"), F.lit('" label="Skeleton path"><geometry><polyline>'))
    plant_open = F.concat(F.lit('<plant id="'), number.cast("string"), F.lit('" label="Plant '), number.cast("string"), F.lit('">'))
    p = F.col("path").cast("long")
    points = points.withColumn("pt", F.struct("x", "y"))
    parts = [
        line(images, low, low, low, 0, head),
        line(plants, number, low, low, 0, plant_open),
        line(paths, number, p, low, 0, opened),
        line(points, number, p, F.col("pos").cast("long"), 1, node(F.col("pt"))),
        line(paths.where("n = 1"), number, p, high, 0, node(F.col("p"))),
        line(paths, number, p, high, 1, F.lit("</polyline></geometry></root>")),
        line(plants, number, high, high, 2, F.lit("</plant>")),
        line(images, high, high, high, 3, F.lit("</scene></rsml>")),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    order = [*rank, "step"]
    if main is not None:
        marks = main.select(*keys, F.col("plant").cast("long").alias("plant"), "x", "y").distinct()
        flagged = points.select(*keys, number.alias("plant"), p.alias("path"), F.col("pos").cast("long").alias("pos"), "x", "y").join(
            marks, [*keys, "plant", "x", "y"], "left_semi"
        ).select(*keys, "plant", "path", "pos", F.lit(1).alias("step"), F.lit(True).alias("_main"))
        lines = lines.join(flagged, [*keys, *order], "left").withColumn(
            "value", F.when(F.col("_main"), F.regexp_replace("value", "/>$", ' main="true"/>')).otherwise(F.col("value"))
        ).drop("_main")
    return lines.select(*keys, F.struct(*order).alias("line_no"), "value")


def write_geometry(lines: DataFrame, target: str) -> None:
    """Write one text folder per image, lines in order; an existing target is refused.

    Spark's own committer makes the export appear only when it is complete.
    """
    named = lines.withColumn("folder", ft.export_folder(F.col("group_id")))
    ordered = named.repartitionByRange("folder", "frame_no", "line_no").sortWithinPartitions("folder", "frame_no", "line_no")
    ordered.select("value", "folder", "frame_no").write.mode("errorifexists").partitionBy("folder", "frame_no").text(target)
