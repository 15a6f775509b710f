"""Saved search responses as a data source that takes filters into its search body and leaves them to Spark as well."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.canonical import canonical
from .readers import RAW, hits, newest

#: The fields that the columns stand for in a search body, and its range operators.
FIELDS = {"event_ts": "timestamp", "level": "rule.level"}
RANGES = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}
SCHEMA = "item string, event_ts timestamp, level int"
_ARROW = pa.schema([("item", pa.string()), ("event_ts", pa.timestamp("us", "UTC")), ("level", pa.int32())])


def _utc(at: datetime) -> datetime:
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def clause(f: Filter) -> dict[str, Any] | None:
    """A filter as a clause of the search body; None if it is none that a body can hold."""
    column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
    if column not in FIELDS or not isinstance(f, (EqualTo, *RANGES)):
        return None
    value = _utc(f.value).isoformat() if isinstance(f.value, datetime) else f.value
    return {"term": {FIELDS[column]: value}} if isinstance(f, EqualTo) else {"range": {FIELDS[column]: {RANGES[type(f)]: value}}}


def search_body(clauses: list[dict[str, Any]], size: int | None = None) -> dict[str, Any]:
    """The search body of clauses, newest first; a floor of level 0 or less is none, so that it can't keep out alerts without a level."""
    def idle(c: dict[str, Any]) -> bool:
        floor = c.get("range", {}).get(FIELDS["level"], {})
        return set(floor) == {"gte"} and floor["gte"] <= 0

    body = {"query": {"bool": {"filter": [c for c in clauses if not idle(c)]}}, "sort": [{FIELDS["event_ts"]: {"order": "desc"}}]}
    return body if size is None else body | {"size": size}


def _holds(c: dict[str, Any], values: dict[str, Any]) -> bool:
    """Whether a hit's values meet a clause; a missing value doesn't."""
    (kind, inner), = c.items()
    (field, want), = inner.items()
    got = values.get(field)
    if got is None:
        return False
    def typed(v: Any) -> Any:
        return datetime.fromisoformat(v) if isinstance(got, datetime) else v

    if kind == "term":
        return got == typed(want)
    (op, bound), = want.items()
    bound = typed(bound)
    return {"gt": got > bound, "gte": got >= bound, "lt": got < bound, "lte": got <= bound}[op]


def _moment(payload: dict) -> datetime | None:
    """ISO text or epoch seconds of the first field that is there, in UTC; None if malformed."""
    v = next((payload[k] for k in ("@timestamp", "timestamp") if payload.get(k) not in (None, "")), None)
    try:
        return datetime.fromtimestamp(v, UTC) if isinstance(v, (int, float)) and not isinstance(v, bool) else _utc(datetime.fromisoformat(v.strip()))
    except (AttributeError, ValueError, OverflowError, OSError):
        return None


def _level(payload: dict) -> int:
    rule = payload.get("rule")
    try:
        level = int(str(rule.get("level")).strip()) if isinstance(rule, dict) else 0
    except ValueError:
        return 0
    return level if abs(level) < 1 << 31 else 0


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SavedResponsesReader(DataSourceReader):
    """A partition a file; hits that the body rules out are left behind before they become rows."""

    def __init__(self, path: str, applies: bool):
        self.path, self.applies, self.clauses = path, applies, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            c = clause(f)
            if c is not None:
                self.clauses.append(c)
            yield f  # what a server did with its body is not known, so all filters are left to Spark too

    def partitions(self) -> list[InputPartition]:
        system, at = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path.removeprefix("file:"))
        if system.get_file_info(at).type == pyarrow.fs.FileType.File:
            return [_File(at)]
        return [_File(i.path) for i in sorted(system.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda i: i.path) if i.path.endswith(".json")]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder
            return
        system = pyarrow.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pyarrow.fs.LocalFileSystem()
        with system.open_input_stream(partition.path) as f:
            doc = json.loads(f.read())
        inner = doc.get("hits") if isinstance(doc, dict) else None
        found = inner.get("hits") if isinstance(inner, dict) else None
        kept = search_body(self.clauses)["query"]["bool"]["filter"] if self.applies else []
        rows: list[tuple] = []
        for hit in found if isinstance(found, list) else []:
            payload = hit.get("_source") or hit if isinstance(hit, dict) else None
            if not isinstance(payload, dict):
                continue
            at, level = _moment(payload), _level(payload)
            if all(_holds(c, {FIELDS["event_ts"]: at, FIELDS["level"]: level}) for c in kept):
                rows.append((canonical(hit), at, level))
            if len(rows) == 1024:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class SavedResponses(DataSource):
    """Hits of saved search responses, a JSON file or a folder of them (``path``): item (canonical JSON text), event_ts, level.

    Options: ``applies``: "false" for responses whose server ignored its body, which then keep all hits. Hits that are no objects are
    left out (``readers.hits`` counts them); a missing or malformed level is 0, a missing or malformed time null.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> SavedResponsesReader:
        return SavedResponsesReader(self.options["path"], self.options.get("applies", "true").lower() == "true")


def saved_hits(spark: SparkSession, path: str, applies: bool = True) -> DataFrame:
    """The rows of ``SavedResponses``; filters by event_ts and level go into its search body. Turns on the session's pushdown into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedResponses)
    return spark.read.format("saved_responses").option("path", path).option("applies", str(applies)).load()


def indexer_since(spark: SparkSession, path: str, since: datetime, least_level: int = 0, limit: int | None = 100, applies: bool = True) -> DataFrame:
    """Raw events of saved indexer responses from ``since`` on, of ``least_level`` or more: filtered in the source, and again behind it."""
    rows = saved_hits(spark, path, applies).where((F.col("event_ts") >= F.lit(_utc(since))) & (F.col("level") >= least_level))
    return newest(hits(rows.select(F.col("item").alias("text")), "text", "wazuh-indexer", "wazuh").where("usable"), limit).select(*RAW)
