"""Secret scans through an incremental blob ledger.

Every historical version of every path is a blob, named by the SHA-256 of its
text. The ledger holds a row for each pair of blob and rule version scanned so
far, with its findings. A scan looks only at pairs that the ledger lacks, each
blob once however many paths hold it, and joins findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.session import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    version: str
    pattern: str
    group: int
    least: int
    #: One of these, in lower case, is in the lower-cased text of any match; none given: no such test.
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The rules by kind, in the order in which kinds are listed.
RULES = (
    Rule("assign", "1", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", "1", r"[0-9a-f]+", 0, 16),
)

_HEX = np.zeros(256, np.uint8)
_HEX[[*range(48, 58), *range(97, 103)]] = 1
_HEX_TABLE = _HEX.tobytes()


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of each secret, by start, then in the order of the rules."""
    low, found = text.lower(), []
    for n, rule in enumerate(rules):
        if rule.needs and not any(word in low for word in rule.needs):
            continue
        pattern = rule.pattern
        if pattern == r"[0-9a-f]+":
            # A greedy run is maximal, so runs that are long enough can be sought directly.
            if b"\x01" * rule.least not in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
                continue
            pattern = r"[0-9a-f]{%d,}" % rule.least
        for m in re.finditer(pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), n, m.end()))
    return sorted(found)


_COLUMNS = "blob string, rule string, kind string, start long, end long"


def _scanned(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """For each blob a list of (rule, start, end) over the rules asked for."""
    for batch in batches:
        asked = batch.column(2).to_pylist()
        out = []
        for text, names in zip(batch.column(1).to_pylist(), asked):
            own = tuple(r for r in rules if r.name in names) if names is not None else rules
            out.append([{"rule": own[n].name, "start": s, "end": e} for s, n, e in scan_text(text or "", own)])
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["blob", "findings"])


FINDINGS = "array<struct<rule:string,start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: blob, rules (the names scanned), findings, for the blobs of ``docs`` that the ledger lacks.

    ``ledger`` has rows of this same form from earlier scans. A blob that it
    holds under all current rule versions isn't read again; one that it holds
    under some is scanned under the others alone.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(blob_id(F.col(text_col)).alias("blob"), text.alias("text"))
    if ledger is None:
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("asked", names)
    else:
        seen = cut(ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules])).distinct().groupBy("blob").agg(F.collect_set("rule").alias("had")))
        unseen = blobs.join(seen, "blob", "left").withColumn("asked", F.array_except(names, F.coalesce("had", F.array().cast("array<string>"))))
        unseen = unseen.where(F.size("asked") > 0).groupBy("blob").agg(F.first("text").alias("text"), F.first("asked").alias("asked"))
    scanned = unseen.select("blob", "text", "asked").mapInArrow(partial(_scanned, rules=rules), f"blob string, findings {FINDINGS}")
    if ledger is None:
        return scanned.select("blob", names.alias("rules"), "findings")
    return scanned.join(unseen.select("blob", "asked"), "blob").select("blob", F.col("asked").alias("rules"), "findings")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings by path, the ledger with what this scan adds).

    Findings: one row per input row, ``id_col`` and findings, an array of (kind,
    start, end) in code points, end exclusive, by start and then in the order of
    the rules. A null text is as an empty one; null ids and repeated rows get
    their blob's findings like any other; an empty table gives none. Other
    columns are ignored, whatever their names.
    """
    added = cut(scan_blobs(docs, text_col, rules, ledger))
    whole = added if ledger is None else ledger.select("blob", "rules", "findings").unionByName(added)
    current = [r.name for r in rules]
    order = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.name), F.lit(n))])
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    held = whole.where(F.size("findings") > 0).select("blob", F.filter("findings", lambda f: f["rule"].isin(current)).alias("findings"))
    if ledger is not None:
        # A blob has a row for each scan that found something new to ask of it: as many as rule versions at most.
        held = held.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
    sorted_ = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), order[f["rule"]].alias("order"), kinds[f["rule"]].alias("kind"), f["end"].alias("end"))))
    held = cut(held.select("blob", F.transform(sorted_, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings")))
    paths = docs.select(F.col(id_col).alias("id"), blob_id(F.col(text_col)).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    out = paths.join(held, "blob", "left").select(F.col("id").alias(id_col), F.coalesce("findings", none).alias("findings"))
    return out, whole


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the spans as text. The ledger method adds no spans to the rules' own."""
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select(id_col, *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _oracle_kind(kind: str, pattern: str, least: int, value: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, first AS start, first + length(hit) AS stop FROM (
    SELECT doc_id, hits[i] AS hit, vals[i] AS val,
           list_sum(list_transform(parts[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0) AS first
    FROM (SELECT doc_id, hits, vals, parts, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS hits, regexp_extract_all(t, '{quoted}', {value}) AS vals, string_split_regex(t, '{quoted}') AS parts FROM docs)))
  WHERE length(val) >= {least}"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_oracle_kind(r.kind, r.pattern, r.least, str(r.group)) for r in RULES)}),
listed AS (
  SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans,
         count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h
  FROM found GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""
