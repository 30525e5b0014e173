"""Multi-set text files of any size, read in the ranges that Spark's text reader cuts them into.

What a line means depends on those before it: settings hold from where they stand, sets are counted, and a set may
begin ranges earlier. So each range is first outlined without knowing what comes before it: the settings it leaves, the
part before its first blank line, which may belong to a set from before, how many sets begin behind, and what the first
and last of these hold. The outlines of a file, one row a range, are composed in order, which gives every range the
state that it starts in; then all ranges are parsed at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.points import checkpointed
from pointloom.sources.readers import POINTS, SETTINGS, MultisetParser, classified, multiset_start, numbered

#: Lines after which the parsed points leave a task.
BATCH_LINES = 20_000


def _fragment() -> dict:
    """Part of a set: whether a line opened it, its events (data lines by their interval, splits) and what names it."""
    return {"opened": False, "events": [], "name": None, "data": False}


class Outline:
    """What a range of lines does to the state, whatever that is."""

    def __init__(self) -> None:
        self.settings: dict = {}
        self.head, self.blank = _fragment(), False
        self.first: dict | None = None  # of the sets that begin behind the first blank line
        self.last: dict | None = None
        self.n_sets, self.open = 0, False

    def read(self, kind: str, value: object) -> None:
        if kind == "blank":
            self.blank = True
            if self.last is not None and self.last["data"]:
                self.open = False
        elif kind in SETTINGS:
            self.settings[kind] = value
        elif kind == "split":
            own = self.last if self.open else None if self.blank else self.head
            if own is not None:
                own["events"].append(["split", None, 1])
        elif kind in ("data", "name", "n_obs", "assoc"):
            own = self._own()
            own["opened"] = True
            if kind == "name":
                own["name"] = value
            elif kind == "data":
                own["data"] = True
                interval = self.settings.get("interval")
                if own["events"] and own["events"][-1][:2] == ["data", interval]:
                    own["events"][-1][2] += 1
                else:
                    own["events"].append(["data", interval, 1])

    def _own(self) -> dict:
        if not self.blank:
            return self.head
        if not self.open:
            self.last = _fragment()
            self.first = self.first or self.last
            self.n_sets += 1
            self.open = True
        return self.last

    def as_dict(self) -> dict:
        last = None if self.last is self.first else self.last
        return {"settings": self.settings, "head": self.head, "blank": self.blank, "first": self.first, "last": last, "n_sets": self.n_sets, "open": self.open}


def _take(own: dict, part: dict, interval: int) -> None:
    """Add a fragment to the set that it belongs to."""
    for kind, at, count in part["events"]:
        if kind == "data":
            step = at or interval
            own["points"] += -(-(own["seen"] + count) // step) - -(-own["seen"] // step)
            own["seen"] += count
        elif own["points"]:
            own["run"] += 1
    if part["name"] is not None:
        own["name"] = part["name"]


def composed(outlines: list[dict]) -> list[tuple[dict, dict[int, str | None]]]:
    """For each range of a file the state it starts in, and the names that sets over several ranges get in the end."""
    state, starts, names = multiset_start(), [], {}

    def new() -> dict:
        state["sets"] += 1
        return {"set_no": state["sets"] - 1, "name": None, "title": None, "file": None, "labels": {}, "assoc": [], "n_obs": None, "points": 0, "seen": 0, "run": 0}

    for o in outlines:
        starts.append(json.loads(json.dumps(state)))
        own, before = state["open"], state["interval"]
        if own is None and o["head"]["opened"]:
            own = new()
        if own is not None:
            _take(own, o["head"], before)
            names[own["set_no"]] = own["name"]
        if o["blank"] and own is not None and own["points"]:
            own = None
        if o["first"] is not None:
            merged = own is not None
            own = own or new()
            _take(own, o["first"], before)
            names[own["set_no"]] = own["name"]
            if o["last"] is not None:
                state["sets"] += o["n_sets"] - 2
                own = new()
                _take(own, o["last"], before)
                names[own["set_no"]] = own["name"]
            own = own if o["open"] else None
        state["open"] = own
        state |= o["settings"]
    spanning = {s["open"]["set_no"] for s in starts if s["open"]}
    final = {k: v for k, v in names.items() if k in spanning}
    ends = [*starts[1:], state]
    return [(s, {x["open"]["set_no"]: final[x["open"]["set_no"]] for x in (s, e) if x["open"] and x["open"]["set_no"] in final}) for s, e in zip(starts, ends)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _outlines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, own = None, Outline()
    done = []
    for frame in frames:
        for file, block, line in zip(frame["file"], frame["block"], frame["value"]):
            if at != (file, block):
                if at is not None:
                    done.append((*at, json.dumps(own.as_dict())))
                at, own = (file, block), Outline()
            own.read(*classified(line))
    if at is not None:
        done.append((*at, json.dumps(own.as_dict())))
    yield pd.DataFrame(done, columns=["file", "block", "outline"])


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")  # one row a range
    got = composed([json.loads(o) for o in frame["outline"]])
    return pd.DataFrame({"file": frame["file"], "block": frame["block"], "state": [json.dumps([s, list(n.items())]) for s, n in got]})


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in POINTS.split(", ")]
    at, parser, names, n = None, None, {}, 0

    def leave() -> pd.DataFrame:
        return pd.DataFrame([{"file": at[0], **p} for p in parser.named(names)], columns=columns)

    for frame in frames:
        for file, block, line, state in zip(frame["file"], frame["block"], frame["value"], frame["state"]):
            if at != (file, block):
                if parser is not None:
                    yield leave()
                start, given = json.loads(state)
                start["labels"] = {int(k): v for k, v in start["labels"].items()}
                at, parser, names, n = (file, block), MultisetParser(start), dict(map(tuple, given)), 0
            kind, value = classified(line)
            parser.read(kind, value)
            n += 1
            if n >= BATCH_LINES and parser.open is None:  # a set's name may stand behind its data
                yield leave()
                parser.sets, n = [], 0
    if parser is not None:
        yield leave()


def read_multiset_splits(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """The same points as ``readers.read_multiset``, for files of any size: a range of a file is a task.

    ``split_bytes`` is the size of a range; by default it is Spark's ``spark.sql.files.maxPartitionBytes``. The states
    of the ranges are broadcast, some hundred bytes each.
    """
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        if split_bytes:
            for k, v in zip(keys, (split_bytes, 0, 1)):
                spark.conf.set(k, str(v))
        lines = _lines(spark, path)
        found = lines.mapInPandas(_outlines, "file string, block long, outline string")
        states = checkpointed(found.groupBy("file").applyInPandas(_chained, "file string, block long, state string"))
        # cut as the outlines were: both passes read under the same settings
        points = checkpointed(lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "state").mapInPandas(_parsed, POINTS))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return numbered(points)
