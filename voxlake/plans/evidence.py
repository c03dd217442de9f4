"""Evidence over reports of different shapes: JSON as VARIANT, one row per report and requirement."""

from __future__ import annotations

from .sql import add

#: Requirement, the places where reports of different shapes hold its number, and the least that passes.
REQUIREMENTS = (
    ("rows", ("$.summary.rows", "$.rows", "$.counts[0]"), 20),
    ("mean_length", ("$.summary.length.mean", "$.mean"), 500),
    ("quality", ("$.summary.quality", "$.quality.share"), 0.4),
    ("reviewed", ("$.reviewed", "$.review.done"), 1),
)


def reports(d) -> str:
    """A report per source, in one of five shapes: nested, flat, a list with text for numbers, nulls, and no JSON at all."""
    number = lambda x: f"cast({x} AS string)"
    n, mean, share, done = number("n"), number("mean"), number("share"), number("done")
    return f"""SELECT source, CASE n % 5
  WHEN 0 THEN concat('{{"summary": {{"rows": ', {n}, ', "length": {{"mean": ', {mean}, '}}, "quality": ', {share}, '}}, "reviewed": ', {done}, '}}')
  WHEN 1 THEN concat('{{"rows": ', {n}, ', "mean": ', {mean}, ', "quality": {{"share": ', {share}, '}}, "review": {{"done": ', {done}, '}}}}')
  WHEN 2 THEN concat('{{"counts": ["', {n}, '"], "mean": "', {mean}, '", "quality": null, "reviewed": {{}}}}')
  WHEN 3 THEN concat('{{"summary": null, "rows": ', {n}, ', "mean": null, "quality": {{"share": "none"}}, "reviewed": true}}')
  ELSE concat('report of ', source) END AS report FROM (
  SELECT d.source, count(*) AS n, CAST(round(avg(n_chars)) AS bigint) AS mean, round(sum(quality) / cast(greatest(1, count(quality)) AS double), 2) AS share,
         CASE WHEN count(quality) > 15 THEN 1 ELSE 0 END AS done FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id GROUP BY d.source) s"""


def value(d, paths: tuple[str, ...]) -> str:
    """The first number that a report has at one of the places: JSON numbers, text that reads as one, and true or false as 1 or 0."""
    if d.name == "spark":
        return "coalesce(" + ", ".join(f"try_variant_get(v, '{p}', 'double')" for p in paths) + ")"
    one = lambda p: f"CASE json_extract_string(v, '{p}') WHEN 'true' THEN 1e0 WHEN 'false' THEN 0e0 ELSE try_cast(json_extract_string(v, '{p}') AS double) END"
    return "coalesce(" + ", ".join(one(p) for p in paths) + ")"


def evidence(d) -> str:
    """A missing report, place or number fails its requirement."""
    parsed = "try_parse_json(report)" if d.name == "spark" else "CASE WHEN json_valid(report) THEN report::JSON END"
    rows = "\nUNION ALL ".join(f"SELECT source, '{name}' AS requirement, {value(d, paths)} AS value, {least}e0 AS least FROM p" for name, paths, least in REQUIREMENTS)
    return f"""WITH p AS (SELECT source, {parsed} AS v FROM ({reports(d)}) r), e AS (
{rows})
SELECT source, requirement, round(value, 6) AS value, coalesce(value >= least, false) AS passed FROM e"""


add("report_evidence", evidence)
add("evidence_summary", lambda d: f"""SELECT requirement, count(*) AS reports, {d.count_if('value IS NULL')} AS missing, {d.count_if('passed')} AS passed, bool_and(passed) AS met FROM ({evidence(d)}) q GROUP BY requirement""")
