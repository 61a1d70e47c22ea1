"""Sinks: findings as distributed files, and reports in one file, which is written row by row and so holds every finding."""

from __future__ import annotations

import datetime
import html
import json
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith.operators import detectors
from scansmith.operators import findings as O
from scansmith.plans.scan import FINDINGS

COLORS = {"Critical": "#b3261e", "High": "#b26a00", "Medium": "#1f5fa8", "Low": "#5f6368"}


def write_json(findings: DataFrame, path: str) -> None:
    """One JSON object a finding, in as many files as there are partitions."""
    findings.write.mode("overwrite").json(path)


# ---- the objects of each format, made by Spark as one JSON string a row, in order ------------------------------------
def sarif_objects(findings: DataFrame, tool: str = "scansmith") -> DataFrame:
    """(json): one SARIF result a finding, by rule, file, line and message."""
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    told = F.struct(F.concat(F.lit(f"{tool}/"), "category").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return O.sarif_results(findings).orderBy("rule_index", "uri", "start_line", "message").select(F.to_json(told).alias("json"))


def postman_objects(findings: DataFrame, base: str = "") -> DataFrame:
    """(json): one Postman request an endpoint or URL, by name."""
    said = F.when(F.col("source").isNotNull(), F.concat(F.lit("Discovered in "), "source", F.lit(" at line "), F.col("line").cast("string")))
    request = F.struct(F.lit("GET").alias("method"), F.array().cast("array<string>").alias("header"), F.struct(F.col("url").alias("raw")).alias("url"), said.alias("description"))
    return O.postman_items(findings, base).orderBy("name", "url").select(F.to_json(F.struct("name", request.alias("request"))).alias("json"))


def write_objects(objects: DataFrame, path: str) -> None:
    """The objects of a format as distributed files of one object a line, for what no single file should hold."""
    objects.write.mode("overwrite").text(path)


def sarif_rules(findings: DataFrame, tool: str = "scansmith") -> list[dict]:
    """The rules in order of their numbers: one for each category with findings."""
    rows = O.sarif_results(findings).groupBy("rule_index", "category", "level").count().orderBy("rule_index").collect()
    return [{"id": f"{tool}/{c}", "name": c.title(), "shortDescription": {"text": c}, "defaultConfiguration": {"level": level}, "properties": {"tags": ["security", c], "precision": "medium"}} for _, c, level, _ in rows]


def _joined(objects: DataFrame) -> Iterator[str]:
    for i, r in enumerate(objects.toLocalIterator(prefetchPartitions=True)):
        yield (",\n" if i else "") + r["json"]


def sarif_frame(findings: DataFrame, tool: str = "scansmith") -> tuple[str, str]:
    """What stands before and behind the results of a SARIF 2.1.0 document."""
    driver = json.dumps({"name": tool, "rules": sarif_rules(findings, tool)})
    return f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {{"driver": {driver}}}, "results": [\n', "\n]}]}\n"


def sarif(findings: DataFrame, tool: str = "scansmith") -> Iterator[str]:
    """The pieces of a SARIF 2.1.0 document of all results."""
    head, tail = sarif_frame(findings, tool)
    yield head
    yield from _joined(sarif_objects(findings, tool))
    yield tail


def postman_frame(name: str) -> tuple[str, str]:
    """What stands before and behind the items of a Postman 2.1 collection."""
    info = json.dumps({"name": name, "schema": "https://schema.getpostman.com/json/collection/v2.1.0/collection.json"})
    return f'{{"info": {info}, "item": [\n', "\n]}\n"


def postman(findings: DataFrame, base: str = "", name: str = "Discovered endpoints") -> Iterator[str]:
    """The pieces of a Postman 2.1 collection of all items."""
    head, tail = postman_frame(name)
    yield head
    yield from _joined(postman_objects(findings, base))
    yield tail


# ---- reports by category ---------------------------------------------------------------------------------------------
def metadata(target: str, docs: DataFrame | None = None, run: dict | None = None) -> dict:
    """What a report says of its scan: time, target, and of docs (source, text) their number, frameworks and providers of content.

    run: what `scan_run` tells of its files, among it how many were left out or had bytes that are no text.
    """
    out: dict = {"scan_time": datetime.datetime.now().isoformat(timespec="seconds"), "target": target} | ({"run": run} if run else {})
    if docs is not None:
        rows = detectors.document_summary(docs).collect()  # a row a framework and provider
        out["file_count"] = sum(r["n"] for r in rows if r["kind"] == "document")
        out["frameworks"] = [f for f in C.FRAMEWORKS if f in {r["name"] for r in rows if r["kind"] == "framework"}]
        out["cdn_summary"] = {r["name"]: {"count": r["n"], "domains": r["domains"]} for r in sorted(rows) if r["kind"] == "provider"}
    return out


def _in_order(findings: DataFrame, rank: Column) -> Iterable[Row]:
    """Every finding by the rank of its category, then file and insertion; one partition at a time is here."""
    return findings.withColumn("rank", rank).orderBy("rank", "category", *O.INSERTION, "value").toLocalIterator(prefetchPartitions=True)


_FIELDS = [f.split()[0] for f in FINDINGS.split(", ") if not f.split()[0].endswith("_ord")]


def json_report(findings: DataFrame, meta: dict) -> Iterator[str]:
    """The pieces of one JSON document: meta, and the findings of each category."""
    yield f'{{"meta": {json.dumps(meta)}, "findings": {{'
    category = None
    for r in _in_order(findings, O._case(F.col("category"), {c: i for i, c in enumerate(C.CATEGORIES)}, len(C.CATEGORIES))):
        fields = {k: v for k, v in r.asDict().items() if k in _FIELDS and k != "category" and v is not None}
        head = "" if r["category"] == category else f"{']' if category else ''}{', ' * (category is not None)}\n{json.dumps(r['category'])}: ["
        yield f"{head}{'' if head else ','}\n{json.dumps(fields)}"
        category = r["category"]
    yield f"{']' * (category is not None)}}}}}\n"


def markdown(findings: DataFrame, meta: dict) -> Iterator[str]:
    """A summary by risk: the first 20 of each category, and how many more."""
    rolled = O.risk_rollup(findings).orderBy("risk_rank", "category").collect()
    top: dict[str, list] = {}
    for r in O.top_per_category(findings).orderBy("category", "rank").collect():
        top.setdefault(r["category"], []).append(r)
    lines = ["# Security summary", "", f"**Target:** `{meta['target']}`", f"**Total findings:** {sum(r['n'] for r in rolled)}", ""]
    for risk in C.RISK_ORDER:
        own = [r for r in rolled if r["risk"] == risk]
        if own:
            lines += [f"## [{risk.upper()}] {risk} ({sum(r['n'] for r in own)})", ""]
        for r in own:
            lines += [f"### {r['category'].title()} ({r['n']})", ""] + [f"- `{x['value']}` — {x['source']}:{x['line']}" for x in top[r["category"]]]
            lines += [f"- ... and {r['n'] - 20} more"] * (r["n"] > 20) + [""]
    yield "\n".join(lines)


_SEARCH = """<script>
const box = document.getElementById("search"), level = document.getElementById("level");
function sift() {
  const term = box.value.toLowerCase();
  for (const row of document.querySelectorAll("tr.finding")) row.hidden = !row.textContent.toLowerCase().includes(term) && !row.dataset.source.toLowerCase().includes(term);
  for (const part of document.querySelectorAll("section")) part.hidden = level.value !== "" && part.dataset.severity !== level.value;
}
box.oninput = level.onchange = sift;
</script>"""


def html_report(findings: DataFrame, meta: dict) -> Iterator[str]:
    """The pieces of a self-contained page: categories by severity, their findings by file, a search and a choice of severity."""
    ranked = {r["category"]: r for r in O.by_severity(findings).collect()}
    files = {r["category"]: r["files"] for r in O.files_per_category(findings).collect()}
    e = html.escape
    levels = sorted({r["severity"] for r in ranked.values()}, key=lambda s: [x.upper() for x in C.RISK_ORDER].index(s))
    yield f"<!doctype html><html lang=en><meta charset=utf-8><title>{e(meta['target'])}</title><h1>{e(meta['target'])}</h1><p>{e(meta.get('scan_time', ''))}</p>"
    pills = [f"{f}" for f in meta.get("frameworks", [])] + [f"{p} ({x['count']})" for p, x in meta.get("cdn_summary", {}).items()]
    yield f"<p>{e(', '.join(pills))}</p><p><input id=search type=search placeholder=Search> <select id=level><option value=''>All severities</option>{''.join(f'<option>{s}</option>' for s in levels)}</select></p>"
    category = source = None
    for r in _in_order(findings, O.severity_rank(F.col("category"))):
        if r["category"] != category:
            own, source = ranked[r["category"]], None
            color = COLORS.get(own["severity"].title(), COLORS["Low"])
            yield f"{'</table></section>' if category else ''}<section data-severity={own['severity']}><h2>{e(r['category'])} <small style='color:{color}'>{own['severity']}</small></h2><p>{own['n']} findings in {files[r['category']]} files</p><table>\n"
            category = r["category"]
        if r["source"] != source:
            source = r["source"]
            yield f"<tr><th colspan=2>{e(source or '')}</th></tr>\n"
        sure = f" <small>{e(r['confidence'])}</small>" if "confidence" in r and r["confidence"] else ""
        yield f"<tr class=finding data-source=\"{e(source or '')}\"><td>{r['line']}</td><td><code>{e(r['value'])}</code>{sure}</td></tr>\n"
    yield f"{'</table></section>' if category else '<p>No findings</p>'}{_SEARCH}</html>\n"


# ---- messages --------------------------------------------------------------------------------------------------------
def notification(findings: DataFrame, target: str, kind: str = "slack", shown: int = 5) -> dict:
    """The payload for a channel: totals, and for slack the first secrets, redacted. Sending it is the caller's."""
    totals = {r["category"]: r["n"] for r in O.category_totals(findings).collect()}
    n, secrets = totals.get("total", 0), totals.get("secrets", 0)
    if kind == "teams":
        facts = [{"name": k, "value": str(v)} for k, v in (("Target", target), ("Total findings", n), ("Secrets found", secrets))]
        return {"@type": "MessageCard", "themeColor": "FF0000" if secrets else "00FF00", "summary": f"{n} findings", "sections": [{"activityTitle": "Scan complete", "facts": facts, "markdown": True}]}
    lines = ["*Scan complete*", f"Target: `{target}`", f"Total findings: {n}"]
    if secrets:
        lines += [f":warning: *{secrets} secrets*", *(f"- {r['value']}" for r in O.top_secrets(O.redact(findings), shown).collect())]
    return {"attachments": [{"color": "#ff0000" if secrets else "#36a64f", "text": "\n".join(lines)}]}


def notifications(findings: DataFrame, target: str, channels: dict[str, str]) -> dict[str, dict]:
    """For each channel (slack or teams) with an address, by address: what to post there."""
    unknown = set(channels) - {"slack", "teams"}
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    return {address: notification(findings, target, kind) for kind, address in channels.items() if address}


def console(findings: DataFrame, verbose: bool = False) -> Iterator[str]:
    """The lines of a listing: categories in order with their numbers, and every finding if verbose, then the total."""
    totals = {r["category"]: r["n"] for r in O.category_totals(findings).collect()}
    if verbose:
        category = None
        for r in _in_order(findings, O._case(F.col("category"), {c: i for i, c in enumerate(C.CATEGORIES)}, len(C.CATEGORIES))):
            if r["category"] != category:
                category = r["category"]
                yield f"{category}: {totals[category]}"
            yield f"  [{r['source']}:{r['line']}] {r['value']}"
    else:
        yield from (f"{c}: {totals[c]}" for c in C.CATEGORIES if c in totals)
    yield f"total: {totals.get('total', 0)}"


def export_report(findings: DataFrame, folder: str, target: str, formats: tuple[str, ...] = ("json", "html"), redact: bool = False, base: str = "", zipped: bool = False, password: str | None = None, docs: DataFrame | None = None) -> dict[str, str]:
    """Deduplicate, redact if asked to, and write the formats (json, html, sarif, postman, md) below a folder of the driver's; each format's path.

    Files are written row by row and hold all findings; docs adds frameworks and providers to their heads.
    """
    if password:
        raise ValueError("no encrypted archives here; an unencrypted one is not written in their place")
    own = O.deduplicate(findings)
    own = (O.redact(own) if redact else own).cache()
    Path(folder).mkdir(parents=True, exist_ok=True)
    meta, out = metadata(target, docs), {}
    made = {"json": lambda: json_report(own, meta), "html": lambda: html_report(own, meta), "sarif": lambda: sarif(own), "postman": lambda: postman(own, base), "md": lambda: markdown(own, meta)}
    for kind in formats:
        out[kind] = f"{folder}/findings.{kind}"
        with open(out[kind], "w", encoding="utf-8") as f:
            f.writelines(made[kind]())
    own.unpersist()
    if zipped:
        with zipfile.ZipFile(f"{folder}/findings.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in out.values():
                z.write(p, Path(p).name)
        out["zip"] = f"{folder}/findings.zip"
    return out
