"""Readers of many files in parallel, each parsed in one task (``wholetext`` or ``binaryFile``).

For files too large for that there are ``splits`` (the text format in ranges of a file) and ``datasource`` (binary
records and recordings in ranges of a file).
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.points import checkpointed, with_positions

POINTS = "file string, set_no long, name string, idx long, x double, y double, e double, l double, n double, run_id long, columns array<double>"
#: Bytes of text that are passed on at once.
TEXT_BLOCK = 256 << 10
# How the text format writes infinite and missing numbers.
_SIGNS = {"++": math.inf, "+.+": math.inf, "---": -math.inf, "--.-": -math.inf}
_DIRECTIVE = re.compile(r"\*([A-Z0-9_]+)\*\s*(.*)")


def number(token: str) -> float:
    """A number of the text format; ValueError if it is none."""
    return _SIGNS[token] if token in _SIGNS else float(token)


def classified(line: str) -> tuple[str, object]:
    """What a line of the text format is: blank, name, data, a directive's key, or nothing, with its value."""
    line = line.strip()
    if not line:
        return "blank", None
    if line.startswith('"'):
        return "name", line[1:].rstrip('"')
    m = _DIRECTIVE.match(line)
    if not m:
        try:
            return "data", [number(t) for t in re.split(r"[\s,]+", line) if t]
        except ValueError:
            return "nothing", None
    key, rest = m[1], m[2].strip()
    if key == "COLUMNS":
        pairs = dict(re.findall(r"([A-Za-z]\w*)\s*=\s*([-+.\w]+)", rest))
        return "roles", {r: int(pairs.get(r, -1)) for r in ("x", "y", "e", "l", "n")}
    if key in ("SCALEFACT", "SCALFACT"):
        v = [number(t) for t in re.split(r"[\s,]+", rest) if t][:3]
        return "factor", v + [1.0] * (3 - len(v))
    if key in ("LEGEND", "NAME"):
        return "name", rest
    if key == "TITLE":
        return "title", rest
    if key == "FILE":
        return "file", rest
    if key == "N":
        return "n_obs", number(rest.split()[0])
    if key == "ASSOCIATE":
        return "assoc", [number(t) for t in re.split(r"[\s,]+", rest) if t]
    if key == "SPLIT":
        return "split", None
    if key == "INTERVAL":
        return "interval", max(1, int(float(rest.split()[0])))
    if key == "COLUMNLABELS":
        return "labels", {k: p.strip() for k, p in enumerate(re.split(r"\t|,", rest)) if p.strip()}
    return "nothing", None


#: Settings that hold from a line on, over the sets behind it.
SETTINGS = ("roles", "factor", "labels", "interval", "title", "file")


def multiset_start() -> dict:
    """The state before a file's first line: settings, the number of sets so far and the set that is open."""
    return {"roles": {"x": 0, "y": 1, "e": 2, "l": -1, "n": -1}, "factor": [1.0, 1.0, 1.0], "labels": {}, "interval": 1, "title": None, "file": None, "sets": 0, "open": None}


class MultisetParser:
    """Reads the text format line by line from any state on; ``points`` and ``sets`` are what it has read.

    A set is opened by a name, a number of observations, associations or data, and closed by a blank line behind data.
    """

    def __init__(self, state: dict):
        self.settings = {k: state[k] for k in SETTINGS}
        self.n_sets = state["sets"]
        self.open: dict | None = dict(state["open"]) if state["open"] else None
        self.points: list[dict] = []
        self.sets: list[dict] = [self.open] if self.open else []

    def _opened(self) -> dict:
        if self.open is None:
            s = self.settings
            self.open = {"set_no": self.n_sets, "name": None, "title": s["title"], "file": s["file"], "labels": dict(s["labels"]), "assoc": [], "n_obs": None, "points": 0, "seen": 0, "run": 0}
            self.sets.append(self.open)
            self.n_sets += 1
        return self.open

    def read(self, kind: str, value: object) -> None:
        if kind == "blank":
            if self.open and self.open["points"]:
                self.open = None
        elif kind == "data":
            self._data(self._opened(), value)
        elif kind in ("name", "n_obs"):
            self._opened()[kind] = value
        elif kind == "assoc":
            self._opened()["assoc"] += value
        elif kind == "split":
            if self.open and self.open["points"]:
                self.open["run"] += 1
        elif kind in SETTINGS:
            self.settings[kind] = value
            if self.open and kind in ("title", "file", "labels"):
                self.open[kind] = dict(value) if kind == "labels" else value

    def _data(self, own: dict, values: list[float]) -> None:
        s = self.settings
        if own["seen"] % s["interval"] == 0:
            idx, roles = own["points"], s["roles"]
            get = lambda r: values[roles[r]] if 0 <= roles[r] < len(values) else None
            x, y, e = (float(idx), values[0], None) if len(values) == 1 else (get("x"), get("y"), get("e"))
            scaled = [v * f if v is not None else None for v, f in zip((x, y, e), s["factor"])]
            self.points.append({"set_no": own["set_no"], "name": own["name"], "idx": idx, "x": scaled[0], "y": scaled[1], "e": scaled[2], "l": get("l"), "n": get("n"), "run_id": own["run"], "columns": values})
            own["points"] += 1
        own["seen"] += 1

    def named(self, names: dict[int, str | None]) -> list[dict]:
        """The points so far, with their sets' names (those of ``names`` go before); they leave the parser."""
        known = {s["set_no"]: s["name"] for s in self.sets} | names
        out, self.points = self.points, []
        for p in out:
            p["name"] = known[p["set_no"]]
        return out


def parse_multiset(text: str) -> tuple[list[dict], list[dict]]:
    """The points and the sets of a text of several sets.

    Sets are parted by blank lines; a line from a double quote on names its set. A single number is y, with the index
    as x. Directives give columns' roles, scale factors, legends, titles, file names, observations, associations,
    splits, intervals and column labels. Lines that are nothing of this are left out.
    """
    parser = MultisetParser(multiset_start())
    for line in text.splitlines():
        parser.read(*classified(line))
    return parser.named({}), parser.sets


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_multiset(spark: SparkSession, path: str) -> DataFrame:
    """The points of all files; set_id numbers the sets over the files in the order of their paths."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, text in zip(frame["file"], frame["value"]):
                rows = [{"file": file, **p} for p in parse_multiset(text)[0]]
                yield pd.DataFrame(rows, columns=["file", "set_no", "name", "idx", "x", "y", "e", "l", "n", "run_id", "columns"])

    return numbered(_whole_files(spark, path).mapInPandas(run, POINTS))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row per set: file, set_no, name, title, source file, labels, associations, observations, points."""
    schema = "file string, set_no long, name string, title string, source string, labels map<int,string>, assoc array<double>, n_obs double, points long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, text in zip(frame["file"], frame["value"]):
                rows = [(file, s["set_no"], s["name"], s["title"], s["file"], s["labels"], s["assoc"], s["n_obs"], s["points"]) for s in parse_multiset(text)[1]]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.replace("map<int,string>", "map").split(", ")])

    return _whole_files(spark, path).mapInPandas(run, schema)


def numbered(points: DataFrame) -> DataFrame:
    """file_id by the order of the files' paths, and set_id over all files: places in the sorted table of sets."""
    points = checkpointed(points)
    sets = with_positions(points.select("file", "set_no").distinct(), ["file", "set_no"], "set_id")
    files = with_positions(points.select("file").distinct(), ["file"], "file_id")
    known = sets.join(files, "file")  # one row a set
    # dealt by rows: paths shrink so much on disk that tasks cut by bytes would hold very many
    dealt = points.repartition(_tasks(points.sparkSession, points.count()), "file", "set_no")
    return dealt.join(known, ["file", "set_no"])


def read_delimited(spark: SparkSession, path: str, columns: list | None = None, sep: str = "\t", decimal_comma: bool = False) -> DataFrame:
    """A table of numbers with a row of labels; ``columns`` selects by label or place."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"')
    names = df.columns if columns is None else [df.columns[c] if isinstance(c, int) else c for c in columns]
    text = lambda c: F.regexp_replace(F.trim(F.col(f"`{c}`")), ",", ".") if decimal_comma else F.trim(F.col(f"`{c}`"))
    return df.select(*[text(c).try_cast("double").alias(c) for c in names])


def read_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A table with types inferred per column and empty cells as null; without a header columns are named columnNN."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True, nullValue="", emptyValue="")
    return df if header else df.toDF(*[f"column{k:02d}" for k in range(len(df.columns))])


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="")


def parse_records(data: bytes, columns: int, size: int, swap: bool = False, lines: int | None = None, extremes: list[tuple[float, float]] | None = None, offset: int = 0) -> np.ndarray:
    """Binary records as an array of lines: items of 8 or 4 bytes are floats; those of 2 or 1 are whole numbers scaled
    from their range to each column's stored minimum and maximum."""
    kind = {8: "f8", 4: "f4", 2: "u2", 1: "u1"}[size]
    n = (len(data) - offset) // (size * columns) if lines is None else lines
    a = np.frombuffer(data, (">" if swap else "<") + kind, n * columns, offset).reshape(n, columns).astype(float)
    if size < 4:
        if extremes is None:
            raise ValueError("whole numbers need the columns' extremes")
        low, high = np.array(extremes, float).T
        a = low + a / (256**size - 1) * (high - low)
    return a


def read_records(spark: SparkSession, path: str, columns: int, size: int, swap: bool = False, extremes: list[tuple[float, float]] | None = None) -> DataFrame:
    """file, idx and columns (array of double) of each line of the binary files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"]):
                a = parse_records(bytes(data), columns, size, swap, extremes=extremes)
                yield pd.DataFrame({"file": file, "idx": np.arange(len(a)), "columns": list(a)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, idx long, columns array<double>")


# Byte layout of the multi-channel recordings (little-endian, no gaps).
_GENERAL = struct.Struct("<8shfdIhIIIIdhhhh964s")
_CHANNEL = struct.Struct("<2shhffhh8s230s")
_EVENT = struct.Struct("<II80s")
_FULL_SCALE = 3276.8


def parse_recording(data: bytes, drop_zero: bool = True) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Samples (channel, name, units, idx, t, value) and events (position, t, text) of a recording."""
    g = _GENERAL.unpack_from(data)
    n_channels, step, samples, n_events = g[1], g[2] / (g[3] or 1.0), g[4], g[11]
    at, parts = _GENERAL.size, []
    for channel in range(n_channels):
        name, coefficient, offset, _, _, _, _, units, _ = _CHANNEL.unpack_from(data, at)
        at += _CHANNEL.size
        raw = np.frombuffer(data, "<i2", samples, at)
        at += 2 * samples
        if drop_zero and not raw.any():
            continue
        text = lambda b: b.split(b"\0")[0].decode("latin-1").strip()
        idx = np.arange(samples)
        parts.append(pd.DataFrame({"channel": channel, "name": text(name), "units": text(units), "idx": idx, "t": idx * step, "value": raw * (coefficient / _FULL_SCALE) + offset}))
    events = []
    while at + _EVENT.size <= len(data) and len(events) < max(n_events, 0):
        position, _, text = _EVENT.unpack_from(data, at)
        at += _EVENT.size
        events.append((position, position * step, text.split(b"\0")[0].decode("latin-1").strip()))
    kinds = ["channel", "name", "units", "idx", "t", "value"]
    return (pd.concat(parts) if parts else pd.DataFrame(columns=kinds)), pd.DataFrame(events, columns=["position", "t", "text"])


def read_recordings(spark: SparkSession, path: str, events: bool = False) -> DataFrame:
    """The samples of all recordings in long form, or their events."""
    schema = "file string, position long, t double, text string" if events else "file string, channel long, name string, units string, idx long, t double, value double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"]):
                out = parse_recording(bytes(data))[int(events)]
                out.insert(0, "file", file)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def write_processed(df: DataFrame, path: str, folders: int | None = None) -> None:
    """The points that are not discarded, in a folder for each set, or in ``folders`` folders by a hash of the set
    (for collections of very many sets)."""
    kept = df.where(~F.col("discarded")).drop("discarded") if "discarded" in df.columns else df
    if folders is None:
        kept.repartition("set_id").write.mode("overwrite").partitionBy("set_id").parquet(path)
    else:
        part = F.pmod(F.xxhash64("set_id"), F.lit(folders))
        kept.withColumn("folder", part).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(path)


#: Rows that a task of a shuffle takes: their memory does not grow with the table, as it does where sizes on disk decide.
TASK_ROWS = 500_000


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 10_000), -(-rows // TASK_ROWS))


def _multiset_lines(df: DataFrame):
    line = F.concat_ws(" ", "x", "y", "e")
    return F.when(F.col("idx") == 0, F.concat_ws("\n", F.lit(""), F.concat(F.lit('"set '), "set_id"), line)).otherwise(line)


def write_multiset(df: DataFrame, path: str, sets_a_file: int = 25) -> None:
    """Sets (set_id, idx, x, y, e) in the text format: a name, points, a blank line; some neighbouring sets a file.

    The lines of a file are sorted in a task, so nothing is gathered in a row; :func:`write_multiset_file` writes a
    file too large for that.
    """
    rows = df.select(F.lpad(F.floor(F.col("set_id") / sets_a_file).cast("string"), 12, "0").alias("part"), "set_id", "idx", _multiset_lines(df).alias("value"))
    dealt = rows.repartition(_tasks(df.sparkSession, df.count()), "part").sortWithinPartitions("part", "set_id", "idx")
    dealt.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def write_multiset_file(df: DataFrame, path: str) -> None:
    """As :func:`write_multiset` in a single file of any size.

    Ranges of sets are sorted and written by tasks; one task then strings these pieces together in their order, a
    block of text at a time, and holds no more. The pieces stand beside ``path`` and are reached by PyArrow.
    """
    from pointloom.sources.datasource import data_files, file_system

    spark = df.sparkSession
    pieces = f"{path.rstrip('/')}-pieces"
    rows = df.select("set_id", "idx", _multiset_lines(df).alias("value"))
    rows.repartitionByRange(_tasks(spark, df.count()), "set_id", "idx").sortWithinPartitions("set_id", "idx").select("value").write.text(pieces)

    def strung(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["folder"]:
                fs, _ = file_system(folder)
                for file, _ in data_files(folder):  # in the order of their names, which is that of the ranges
                    with fs.open_input_stream(file) as f:
                        rest = b""
                        while block := f.read(TEXT_BLOCK):
                            whole, end, rest = (rest + block).rpartition(b"\n")
                            if end:
                                yield pd.DataFrame({"value": [whole.decode()]})

    one = spark.createDataFrame([(pieces,)], "folder string").coalesce(1)
    one.mapInPandas(strung, "value string").write.mode("overwrite").text(path)


def cut_columns(lines: DataFrame, fields: list[int], sep: str = "\t", missing: str = "0", comment: str = "#", no_data: str | None = None, replacement: str | None = None) -> DataFrame:
    """Fields (from 0) of ragged lines (column value): absent or empty ones become ``missing``, comment lines go, and
    lines that hold the no-data mark go too unless the mark has a replacement."""
    kept = lines.where(~F.col("value").startswith(comment) & (F.length(F.trim("value")) > 0))
    if no_data is not None and replacement is None:
        kept = kept.where(~F.array_contains(F.split("value", re.escape(sep)), no_data))
    parts = F.split("value", re.escape(sep))

    def cell(k: int):
        v = F.get(parts, F.lit(k))
        v = F.when(v.isNull() | (v == ""), missing).otherwise(v)
        return F.when(v == no_data, replacement).otherwise(v) if no_data is not None and replacement is not None else v

    return kept.select(*[cell(k).alias(f"c{i}") for i, k in enumerate(fields)])


def parameter_points(spark: SparkSession, low: float, high: float, n: int, x, y, e=None, set_id: int = 0) -> DataFrame:
    """A set of n points from functions of a parameter t in [low, high]; x, y and e are functions of its column."""
    t = F.lit(low) + F.col("idx") * ((high - low) / max(n - 1, 1))
    rows = spark.range(n).select(F.lit(set_id).cast("long").alias("set_id"), F.col("id").alias("idx")).withColumn("t", t)
    return rows.select("set_id", "idx", x(F.col("t")).alias("x"), y(F.col("t")).alias("y"), *([e(F.col("t")).alias("e")] if e else []))


def write_values(df: DataFrame, path: str, *columns: str) -> None:
    """Selected values per point as tab-separated text."""
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t")


#: Importers by name: the schema of what they give, whether they take text or bytes, and a function of one file's
#: content that returns the rows (a list of tuples or a frame).
IMPORTERS: dict[str, tuple[str, bool, Callable]] = {}


def register_importer(name: str, schema: str, parse: Callable, text: bool = True) -> None:
    """Add a format: ``parse`` takes a file's text, or its bytes, and gives rows of the schema."""
    IMPORTERS[name] = (schema, text, parse)


def read_format(spark: SparkSession, name: str, path: str) -> DataFrame:
    """file and the rows of a registered format, from any store that Spark reads; a file is one task's work."""
    schema, text, parse = IMPORTERS[name]
    names = [c.strip().split()[0] for c in schema.split(",")]
    files = _whole_files(spark, path) if text else spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("value"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, value in zip(frame["file"], frame["value"]):
                rows = parse(value if text else bytes(value))
                out = rows[names] if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=names)
                out.insert(0, "file", file)
                yield out

    return files.mapInPandas(run, f"file string, {schema}")


register_importer("multiset", "set_no long, name string, idx long, x double, y double, e double", lambda text: [(p["set_no"], p["name"], p["idx"], p["x"], p["y"], p["e"]) for p in parse_multiset(text)[0]])
register_importer("recording", "channel long, name string, units string, idx long, t double, value double", lambda data: parse_recording(data)[0], text=False)
