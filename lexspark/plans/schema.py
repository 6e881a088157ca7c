"""Parse schemas made by a pluggable model: samples, prompts, validation, patches.

Prompts and replies are small text work on one document; ``answers`` and ``validated`` do it for tables of documents, with the parse and its
metrics as Spark steps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.detect import densest_window
from ..operators.schema_parse import PATTERNS, parse_by_schema
from ..sources.tables import stage

REQUIRED = ("section_pattern", "hierarchy")
SIGNS = {  # fixed values: feature, what it tells
    "has_chapters": "it has chapter headings",
    "has_parts": "it has parts",
    "has_orders": "it has orders, so it may be a schedule or rules",
    "has_schedules": "it has schedules",
    "has_definitions": "it defines terms",
}
LEAST_CHUNKS, LEAST_CAPTURE, LEAST_OVERALL, LONGEST = 3, 0.40, 0.55, 10_000  # fixed values: when a schema passes on a sample
HINTS = {  # fixed values: metric, threshold, hint
    "capture": (0.50, "section_pattern misses most section numbers"),
    "length": (0.50, "chunks are too short or too long: move the split points"),
    "noise": (0.50, "headers and page numbers end up as chunks"),
    "continuity": (0.40, "section numbers jump: the pattern matches inside sections"),
    "coverage": (0.30, "chapter_pattern is wrong or missing"),
    "overall": (0.70, "the parse as a whole is under the gate"),
}


def stratified_sample(text: Column, head: int = 5000, tail: int = 4000) -> Column:
    """Head, densest window and tail of a document, each once, joined by a mark."""
    parts = F.array_distinct(F.array(F.substring(text, 1, head), densest_window(text), F.substr(text, F.greatest(F.length(text) - tail, F.lit(0)) + 1, F.lit(tail))))
    return F.array_join(parts, "\n\n[...]\n\n")


def head_and_tail(text: Column, size: int = 2500) -> Column:
    """Both ends of a text of over twice ``size`` characters, joined by a mark; the first ``size`` characters of a shorter one."""
    tail = F.substr(text, F.length(text) - size + 1, F.lit(size))
    return F.when(F.length(text) > 2 * size, F.concat(F.substring(text, 1, size), F.lit("\n\n[... middle of document ...]\n\n"), tail)).otherwise(F.substring(text, 1, size))


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, TypeError):
        return False
    return True


def read_schema(reply: str, partial: bool = False) -> dict | None:
    """The JSON object in a reply, if it has the required fields and its patterns compile; of a patch (``partial``) fields with patterns that don't are dropped, and an empty one is none."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.S) or re.search(r"(\{.*\})", reply, re.S)
    try:
        found = json.loads(fenced.group(1)) if fenced else None
    except ValueError:
        return None
    if not isinstance(found, dict) or (not partial and any(not found.get(k) for k in REQUIRED)):
        return None
    bad = [k for k in PATTERNS if found.get(k) and not valid_regex(found[k])]
    if partial:
        return {k: v for k, v in found.items() if k not in bad} or None
    return None if bad else found


def apply_patch(schema: dict, patch: dict) -> dict:
    """Patch fields over the schema's; dictionaries are merged one level deep."""
    return schema | {k: schema[k] | v if isinstance(v, dict) and isinstance(schema.get(k), dict) else v for k, v in patch.items()}


def guidance(metrics: dict[str, float]) -> list[str]:
    return [hint for k, (least, hint) in HINTS.items() if metrics.get(k, 1.0) < least]


def prompt(
    sample: str, doc_type: str, confidence: float, scores: dict[str, float], schema: dict | None = None, metrics: dict[str, float] | None = None, features: dict | None = None, report: list[str] | None = None
) -> str:
    """First request; with ``metrics`` one that starts afresh, knowing what failed; with ``schema`` as well a request for changed fields only.

    ``features`` are the document's signs and its section_count; ``report`` holds lines on failed chunks.
    """
    sure = "certain" if confidence >= 0.70 else "likely" if confidence >= 0.40 else "uncertain"
    top = ", ".join(f"{k} {v:.2f}" for k, v in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3])
    lines = [f"Document type: {doc_type} ({sure})." + (f" Candidates: {top}." if top else "")]
    lines += [f"- {told}" for name, told in SIGNS.items() if (features or {}).get(name)]
    if count := (features or {}).get("section_count"):
        lines.append(f"- it has about {count} sections")
    if schema is None:
        if metrics:
            lines += ["Earlier patterns failed; start afresh with broader ones:", *[f"- {x}" for x in guidance(metrics)]]
        lines.append(f"Answer with one JSON object with {', '.join(REQUIRED)} and optionally {', '.join(PATTERNS[1:])}.")
    else:
        lines += ["The schema " + json.dumps(schema, sort_keys=True) + " parses badly:", *[f"- {x}" for x in guidance(metrics or {})], *[f"- {x}" for x in report or []]]
        lines.append("Answer with one JSON object of the fields to change.")
    return "\n".join([*lines, "Text:", sample])


def generate(sample: str, doc_type: str, confidence: float, scores: dict[str, float], complete: Callable[[str], str], judge: Callable[[dict], dict[str, float]]) -> tuple[dict | None, float]:
    """At most three attempts (fresh, patch of the best, fresh): the best schema that passes on the sample, with its score.

    ``judge`` parses the sample and gives metrics with n_chunks, capture, overall and longest.
    """
    best, best_score, metrics = None, -1.0, {}
    for attempt in range(3):
        patching = attempt == 1 and best is not None
        reply = read_schema(complete(prompt(sample, doc_type, confidence, scores, best if patching else None, metrics)), partial=patching)
        if reply is None:
            continue
        schema = apply_patch(best, reply) if patching else reply
        found = judge(schema)
        if found["overall"] > best_score:
            best, best_score, metrics = schema, found["overall"], found
        if found["n_chunks"] >= LEAST_CHUNKS and found["capture"] >= LEAST_CAPTURE and found["overall"] >= LEAST_OVERALL and found["longest"] <= LONGEST:
            return schema, found["overall"]
    return best, best_score


# ---- tables of documents ------------------------------------------------------------------------------------------

METRICS = (*quality.WEIGHTS, "overall")


def schema_row(schema: dict) -> tuple:
    """The schema's patterns, the year and type among its defaults, and all of it as JSON."""
    defaults = schema.get("metadata_defaults") or {}
    year, kind = (str(defaults[k]) if defaults.get(k) else None for k in ("year", "doc_type"))
    return (*[schema.get(k) or None for k in PATTERNS], year, kind, json.dumps(schema, sort_keys=True))


def answers(asked: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(doc_id, PATTERNS, year, doc_type, schema) of the model's usable replies.

    ``asked``: doc_id, doc_type, confidence, the features, sample and, where an earlier try failed, schema (JSON; null to start afresh), METRICS and
    report. A patch is laid over its schema. A reply that is no schema gives no row; what ``complete`` raises fails the task.
    """
    kind = asked.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", *PATTERNS, "year", "doc_type", "schema"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                old = json.loads(r["schema"]) if isinstance(r.get("schema"), str) else None
                failed = {k: r[k] for k in METRICS if k in r and pd.notna(r[k])}
                report = r.get("report")
                reply = read_schema(complete(prompt(r["sample"], r["doc_type"], r["confidence"], {}, old, failed, r, None if report is None else list(report))), partial=old is not None)
                if reply is not None:
                    out.append((r["doc_id"], *schema_row(apply_patch(old, reply) if old is not None else reply)))
            yield pd.DataFrame(out, columns=columns)

    return asked.mapInPandas(ask, ", ".join([f"doc_id {kind}", *[f"{c} string" for c in columns[1:]]]))


def judged(docs: DataFrame, schemas: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``docs`` by their schemas, and ``schemas`` with METRICS, n_chunks, longest and report; a schema without any chunk scores 0."""
    chunks = stage(parse_by_schema(docs, schemas), f"{name}-chunks")
    found = stage(quality.metrics(chunks), f"{name}-metrics")
    longest = chunks.groupBy("doc_id").agg(F.max(F.length("text")).alias("longest"))
    listed = quality.failure_report(chunks, found).select("doc_id", F.concat("issues", F.transform("failures", lambda x: x["text"])).alias("report"))
    out = schemas.join(found, "doc_id", "left").join(longest, "doc_id", "left").join(listed, "doc_id", "left")
    zero = {**{k: 0.0 for k in METRICS}, "n_chunks": 0, "longest": 0}
    return chunks, stage(out.fillna(zero).select(*schemas.columns, *METRICS, "n_chunks", "longest", "report"), f"{name}-judged")


def validated(docs: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(doc_id, PATTERNS, year, doc_type, schema) by at most three tries for each document on a sample of it: fresh, a patch of the best, fresh again.

    ``docs``: doc_id, doc_title, doc_type, confidence, features, text. A document is asked about no more once a schema passes; the best score
    wins, the earlier of equal ones. Documents without any usable reply have no row.
    """
    sampled = stage(docs.withColumn("sample", stratified_sample(F.col("text"))).withColumn("text", F.col("sample")), "samples")
    best = None
    for attempt in range(3):
        asked = sampled
        if best is not None:
            known = best.select("doc_id", "passed", "report", *METRICS, F.when(F.lit(attempt == 1), F.col("schema")).alias("schema"))
            asked = sampled.join(known, "doc_id", "left").where("passed IS NULL OR NOT passed").drop("passed")
        replies = stage(answers(asked.drop("text"), complete), f"replies-{attempt}")
        _, tried = judged(sampled.select("doc_id", "doc_title", "text"), replies, f"try-{attempt}")
        good = (F.col("n_chunks") >= LEAST_CHUNKS) & (F.col("capture") >= LEAST_CAPTURE) & (F.col("overall") >= LEAST_OVERALL) & (F.col("longest") <= LONGEST)
        tried = tried.withColumn("passed", good).withColumn("turn", F.lit(-attempt))
        every = tried if best is None else best.unionByName(tried)
        top = F.max_by(F.struct(*[c for c in every.columns if c not in ("doc_id", "passed")]), F.struct("overall", "turn")).alias("top")
        best = stage(every.groupBy("doc_id").agg(top, F.max("passed").alias("passed")).select("doc_id", "passed", "top.*"), f"best-{attempt}")
    return best.select("doc_id", *PATTERNS, "year", "doc_type", "schema")
