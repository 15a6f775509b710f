"""Temporal-entity clustering of alerts into candidates, and of candidates into incidents.

The rules are greedy and order-dependent: rows in time order join the newest group that accepts them. Groups never hold
members of two entity components, so rows are laid in order of (component, time) in range partitions. Alerts are scanned a batch at a time
with only the groups that are still open in memory; ranges are scanned side by side, each first from no open group and again from those that
the range before it left open, until these are the ones it began with. Ranges that don't settle so are scanned in turn by one task a component.
Incidents split exactly into islands: a row after a gap longer than the window can join no earlier group of its component. Islands
are found by a scan of range partitions; the rule itself runs per island in one Arrow-backed function.
"""

from __future__ import annotations

import json
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import entity_components, persisted
from .ordinal import _placed, islands, ranked

WINDOW_MINUTES, CAP = 30, 50
INCIDENT_MINUTES, INCIDENT_SCORE = 120, 8


def entities(alerts: DataFrame) -> Column:
    """Prefixed lower-case entities of an alert."""
    one = lambda kind, c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(kind + ":"), F.lower(F.trim(F.col(c)))))
    own = F.array(*(one(k, c) for k, c in (("agent", "agent_id"), ("host", "hostname"), ("user", "user"), ("src", "src_ip"), ("dst", "dst_ip")) if c in alerts.columns))
    if "rule_groups" in alerts.columns:
        groups = F.transform(F.coalesce("rule_groups", F.array().cast("array<string>")), lambda g: F.when(F.trim(g) != "", F.concat(F.lit("rule_group:"), F.lower(F.trim(g)))))
        own = F.concat(own, groups)
    return F.array_distinct(F.array_compact(own))


def _bucket(rows: DataFrame) -> Column:
    """Islands dealt by hash: many small ones share a call, and one is never split."""
    return F.pmod(F.xxhash64("component", "island"), F.lit(8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("bucket")


class _Open:
    """The groups that a further row may join, by entity: [rows, last, first id, number, entities], older before newer.

    Rows come in time order, so a group that is full or past the window never opens again and is dropped.
    """

    def __init__(self, window_us: int, cap: int) -> None:
        self.window, self.cap = window_us, cap
        self.load(None)

    def load(self, state: bytes | None) -> None:
        """Goes on from a ``state``; None: from no open group."""
        self.component, self.ts, groups = json.loads(zlib.decompress(state)) if state else (None, None, [])
        self.groups: dict[str, list[list]] = {}
        self.made, self.held = 0, 0
        for n, last, own, names in groups:
            self._enter([n, last, own, self.made, set()], names)
            self.made += 1
        self.bound = 2 * self.held + 4096

    def _enter(self, group: list, names: list[str]) -> None:
        for name in names:
            if name not in group[4]:
                group[4].add(name)
                held = self.groups.get(name)
                if not held:
                    self.groups[name] = [group]
                elif held[-1][3] < group[3]:
                    held.append(group)
                else:
                    insort(held, group, key=_number)
                self.held += 1

    def _near(self, group: list) -> bool:
        return group[0] < self.cap and (self.ts is None or group[1] is None or self.ts - group[1] <= self.window)

    def _sweep(self) -> None:
        self.groups = {name: left for name, held in self.groups.items() if (left := [g for g in held if self._near(g)])}
        self.held = sum(map(len, self.groups.values()))
        self.bound = 2 * self.held + 4096

    def state(self) -> tuple[bytes | None, int | None]:
        """The open groups, None if there are none, and the last time at which one is near (None: at any time)."""
        self._sweep()
        groups = sorted({g[3]: g for held in self.groups.values() for g in held}.values(), key=_number)
        if not groups:
            return None, None
        lasts = [g[1] for g in groups]
        until = None if None in lasts else max(lasts) + self.window
        return zlib.compress(json.dumps([self.component, self.ts, [[g[0], g[1], g[2], sorted(g[4])] for g in groups]]).encode(), 1), until

    def place(self, component: str, ts: int | None, own: str, names: list[str]) -> str:
        """The first id of the row's group."""
        if component != self.component:
            self.component, self.groups, self.held = component, {}, 0
        self.ts = ts
        at, group, number = self.groups, None, -1
        expired, cap = (-1 << 63 if ts is None else ts - self.window), self.cap
        for name in names:
            held = at.get(name)
            if held:
                newest = held[-1]
                while newest[0] >= cap or (newest[1] is not None and newest[1] < expired):
                    held.pop()
                    self.held -= 1
                    if not held:
                        break
                    newest = held[-1]
                else:
                    if newest[3] > number:
                        group, number = newest, newest[3]
        if group is None:
            group = [0, None, own, self.made, set()]
            self.made += 1
        if not group[4].issuperset(names):
            self._enter(group, names)
            if self.held > self.bound:
                self._sweep()
        group[0] += 1
        if ts is not None:
            group[1] = ts
        return group[2]


def _number(group: list) -> int:
    return group[3]


def _listed(values: pa.Array) -> list:
    """As to_pylist, without a scalar for each value."""
    return values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()


_SCANNED = "id string, cluster string, span long, component string, ts long, tail string, until long, state binary"


def _scan(window_us: int, cap: int, starts: dict[int, bytes]) -> Callable:
    """The rule over sorted (span, component, ts, id, entities), each span from its start: (id, cluster) of its rows, and a row for the span.

    That row has the component and time of the first alert (``component``, ``ts``), the component of the last (``tail``), and what stays open.
    """

    def ended(span: int, head: tuple, groups: _Open) -> pa.RecordBatch:
        state, until = groups.state()
        return pa.RecordBatch.from_pylist([{"span": span, "component": head[0], "ts": head[1], "tail": groups.component, "until": until, "state": state}], schema=shape)

    shape = pa.schema([("id", pa.string()), ("cluster", pa.string()), ("span", pa.int64()), ("component", pa.string()), ("ts", pa.int64()), ("tail", pa.string()), ("until", pa.int64()), ("state", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, at, head = _Open(window_us, cap), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, components, ts, ids = (_listed(batch.column(c)) for c in ("span", "component", "ts", "id"))
            lists = batch.column("entities")
            names, offsets = _listed(lists.flatten()), lists.offsets.to_numpy()
            offsets = (offsets - offsets[0]).tolist()
            out = []
            for k, span in enumerate(spans):
                if span != at:
                    if at is not None:
                        yield ended(at, head, groups)
                    groups.load(starts.get(span))
                    at, head = span, (components[k], ts[k])
                out.append(groups.place(components[k], ts[k], ids[k], names[offsets[k] : offsets[k + 1]]))
            empty = [pa.nulls(len(out), f.type) for f in list(shape)[3:]]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), pa.array(out, pa.string()), batch.column("span"), *empty], schema=shape)
        if at is not None:
            yield ended(at, head, groups)

    return run


def _settled(rows: DataFrame, window_us: int, cap: int) -> DataFrame:
    """(id, cluster) of rows in sorted range partitions (span): what one scan of all of them would give.

    A span is right if the span before it is and left open what this one began with. Spans that began with something else are scanned
    again side by side as long as that leaves less than half of them, else in turn from the first such span of a component to its last. The driver
    sees what stays open after each span, which the window bounds.
    """
    todo, began, ends, scans = None, {}, {}, []
    while todo is None or todo:
        mine = rows if todo is None else rows.where(F.col("span").isin(todo))
        out = persisted(mine.mapInArrow(_scan(window_us, cap, began), _SCANNED))
        ends |= {r["span"]: r for r in out.where("id IS NULL").drop("id", "cluster").collect()}
        scans.append((out, set(ends) if todo is None else set(todo)))
        order = sorted(ends)
        starts = {b: ends[a]["state"] for a, b in zip(order, order[1:]) if _meets(ends[a], ends[b])}
        wrong = [s for s in order if starts.get(s) != began.get(s)]
        if todo is not None and 2 * len(wrong) > len(todo):
            chains, last = {}, None
            for s in order:
                # a component's spans from the first wrong one on are one chain
                if ends[s]["component"] == last:
                    chains[s] = first
                elif s in wrong:
                    chains[s] = first = s
                last = ends[s]["component"] if s in chains else None
            dealt = rows.where(F.col("span").isin(list(chains))).withColumn("chain", F.create_map(*(F.lit(x) for c in chains.items() for x in c))[F.col("span")])
            dealt = dealt.repartition("chain").sortWithinPartitions("chain", "span", "_index").withColumn("span", F.col("chain"))
            scans.append((persisted(dealt.drop("chain").mapInArrow(_scan(window_us, cap, starts), _SCANNED)), set(chains)))
            break
        todo, began = wrong, starts
    right, seen = None, set()
    for out, spans in reversed(scans):
        # a span's last scan is the right one; a chain's rows have its first span's number
        own = out.where(F.col("id").isNotNull() & F.col("span").isin(sorted(spans - seen))).select("id", "cluster")
        right, seen = own if right is None else right.unionByName(own), seen | spans
    return right


def _meets(before: dict, after: dict) -> bool:
    """Whether a span's first alert may join what the span before it left open."""
    if before["state"] is None or before["tail"] != after["component"]:
        return False
    return before["until"] is None or after["ts"] is None or after["ts"] <= before["until"]


def cluster(alerts: DataFrame, minutes: int = WINDOW_MINUTES, cap: int = CAP) -> DataFrame:
    """(id, cluster) of alerts with ``entities``: cluster is the id of its first alert. Ids must differ. Alerts without entities stand alone."""
    rows = alerts.select(F.col("id").cast("string").alias("id"), F.unix_micros("event_ts").alias("ts"), F.array_compact("entities").alias("entities"))
    linked = rows.where("size(entities) > 0").withColumn("lead", F.col("entities")[0])
    comp = entity_components(linked.select("lead", F.explode("entities").alias("entity")), "lead", "entity")
    laid = _placed(linked.join(comp, "lead").drop("lead"), ["component", "ts", "id"], None).withColumnRenamed("_part", "span")
    grouped = _settled(laid.select("id", "ts", "entities", "component", "span", "_index"), minutes * 60_000_000, cap)
    return grouped.unionByName(rows.where("size(entities) = 0").select("id", F.col("id").alias("cluster")))


def sessions(rows: DataFrame, by: list[str], minutes: int, ts: str = "event_ts", own: str = "id") -> DataFrame:
    """Rows with ``session`` (number within ``by``): a new one after each gap over the window. What the greedy rule gives for one entity a row and no cap."""
    order = Window.partitionBy(*by).orderBy(ts, own)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(order)
    return rows.withColumn("_new", F.when(gap > minutes * 60_000_000, 1).otherwise(0)).withColumn("session", F.sum("_new").over(order)).drop("_new")


def candidates(alerts: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a cluster: span, first host and user in time order, ordered distinct addresses, agents, alert ids, and its candidate id.

    The ordinal is the rank of the cluster's first alert among all clusters.
    """
    if "agent_id" not in alerts.columns:
        alerts = alerts.withColumn("agent_id", F.lit(None).cast("string"))
    rows = alerts.join(clusters, "id").withColumn("at", F.struct(F.col("event_ts").isNotNull().alias("dated"), "event_ts", F.col("id").alias("k")))
    filled = lambda c: F.min_by(c, F.when(F.trim(F.col(c)) != "", F.col("at")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "id", "src_ip", "dst_ip", "agent_id")))
    each = lambda f: F.array_distinct(F.array_compact(F.transform("members", lambda m: F.nullif(F.trim(m[f]), F.lit("")))))
    folded = rows.groupBy("cluster").agg(F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), filled("hostname").alias("primary_host"), filled("user").alias("primary_user"), ordered.alias("members"), F.min("at").alias("first_at"), F.count(F.lit(1)).alias("alert_count"))
    folded = folded.select("cluster", "first_seen", "last_seen", "primary_host", "primary_user", "alert_count", "first_at", F.transform("members", lambda m: m.id).alias("alert_ids"), each("src_ip").alias("src_ips"), each("dst_ip").alias("dst_ips"), each("agent_id").alias("agent_ids"))
    return numbered(folded, "CAND", F.concat_ws(":", F.array_sort("alert_ids")), "candidate_id")


def numbered(rows: DataFrame, prefix: str, content: Column, name: str) -> DataFrame:
    """<prefix>-<date or unknown>-<ordinal>-<hash> for rows with first_seen and first_at: the ordinal counts all groups in order of hour, then of first_at."""
    rows = ranked(rows.withColumn("_hour", F.date_trunc("hour", "first_seen")), [F.asc_nulls_first("_hour"), F.asc("first_at")], "_number")
    date = F.coalesce(F.date_format("first_seen", "yyyyMMdd"), F.lit("unknown"))
    return rows.drop("_hour").withColumn(name, F.concat_ws("-", F.lit(prefix), date, F.format_string("%03d", F.col("_number")), F.substring(F.sha2(content, 256), 1, 10))).drop("_number")


def _greedy_candidates(window_us: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["component", "island", "moment", "id"], kind="stable")
        groups: list[dict] = []
        out, at = [], None
        for island, own, moment, first, last, dated, names in zip(zip(rows["component"], rows["island"], strict=True), rows["id"], rows["moment"], rows["first"], rows["last"], rows["dated"], rows["entities"], strict=True):
            if island != at:
                groups, at = [], island
            names = set(names)
            for g in reversed(groups):
                near = not dated or g["first"] is None or g["first"] - window_us <= moment <= g["last"] + window_us
                if near and not names.isdisjoint(g["names"]):
                    break
            else:
                g = {"first": None, "last": None, "names": set(), "first_id": own}
                groups.append(g)
            g["names"] |= names
            if dated:
                g["first"] = first if g["first"] is None else min(g["first"], first)
                g["last"] = last if g["last"] is None else max(g["last"], last)
            out.append((own, g["first_id"]))
        return pd.DataFrame(out, columns=["id", "incident"])

    return run


def incident_entities(scored: DataFrame) -> Column:
    """Typed entities of a candidate: host, user, addresses, and the agents of its alerts."""
    agents = F.transform("agent_ids", lambda x: F.concat(F.lit("agent:"), x)) if "agent_ids" in scored.columns else F.array().cast("array<string>")
    lower = lambda kind, c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(kind), F.lower(F.trim(F.col(c)))))
    return F.array_distinct(F.array_compact(F.concat(F.array(lower("host:", "primary_host"), lower("user:", "primary_user")), F.transform("src_ips", lambda x: F.concat(F.lit("src:"), x)), F.transform("dst_ips", lambda x: F.concat(F.lit("dst:"), x)), agents)))


def promoted(scored: DataFrame, least: int = INCIDENT_SCORE, paged: bool = True) -> DataFrame:
    """Candidates that qualify: by score, or (``paged``) because the routed action, else the triage action, pages."""
    action = F.coalesce("routed_action", "action") if "routed_action" in scored.columns else F.col("action")
    ok = F.col("score") >= least
    return scored.where(ok | (action == "page_now") if paged else ok)


def incidents(scored: DataFrame, minutes: int = INCIDENT_MINUTES) -> DataFrame:
    """Incidents of qualifying candidates (candidate_id, first_seen, last_seen, primary_host, primary_user, src_ips, dst_ips, score, alert_count)."""
    dated = F.coalesce("first_seen", "last_seen")
    rows = scored.withColumn("entities", incident_entities(scored)).select(F.col("candidate_id").alias("id"), F.coalesce(F.unix_micros(dated), F.lit(0)).alias("moment"), F.unix_micros(dated).alias("first"), F.unix_micros(F.coalesce("last_seen", "first_seen")).alias("last"), dated.isNotNull().alias("dated"), "entities")
    linked = rows.where("size(entities) > 0")
    comp = entity_components(linked.select("id", F.explode("entities").alias("entity")), "id", "entity")
    found = islands(linked.join(comp, "id"), "component", "moment", "last", ~F.col("dated"), minutes * 60_000_000)
    grouped = found.select("id", "moment", "first", "last", "dated", "entities", "component", "island").groupBy(_bucket(linked)).applyInPandas(_greedy_candidates(minutes * 60_000_000), "id string, incident string")
    grouped = grouped.unionByName(rows.where("size(entities) = 0").select("id", F.col("id").alias("incident")))
    members = scored.join(grouped.withColumnRenamed("id", "candidate_id"), "candidate_id")
    usual = lambda c: F.expr(f"mode() WITHIN GROUP (ORDER BY nullif(trim({c}), ''))")  # noqa: E731  ties: the smallest
    folded = members.groupBy("incident").agg(
        F.array_sort(F.collect_list("candidate_id")).alias("candidate_ids"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), usual("primary_host").alias("primary_host"), usual("primary_user").alias("primary_user"), F.max("score").alias("max_score"),
        F.sum("alert_count").alias("alert_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("src_ips")))).alias("src_ips"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dst_ips")))).alias("dst_ips"), F.min(F.struct("first_seen", "candidate_id")).alias("first_at"),
    )
    return numbered(folded, "INC", F.concat_ws("|", "candidate_ids"), "incident_id")


def members(incidents: DataFrame, candidates: DataFrame, alerts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Alerts with the incident and the candidate that they belong to."""
    of = incidents.select("incident_id", F.explode("candidate_ids").alias("candidate_id")).join(candidates.select("candidate_id", "cluster"), "candidate_id")
    return alerts.join(clusters, "id").join(of, "cluster").drop("cluster")
