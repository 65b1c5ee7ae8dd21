"""Scan reports as text, one a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import var

_ALIAS = {"md": "markdown", "txt": "text"}


def report(scans: DataFrame, fmt: str, id_: str = "doc_id") -> DataFrame:
    """(id, report) from what ``scan`` or ``scan_report`` gives."""
    fmt = _ALIAS.get(fmt, fmt)
    d, i, k = var("d"), var("i"), var("k")
    counts = f"array_sort(map_keys(entity_counts))"  # noqa: F541
    listed = lambda line: f"array_join(transform({counts}, {k} -> {line}), '')"
    each = lambda line: f"array_join(transform(detections, ({d}, {i}) -> {line}), '')"
    safe = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    cell = lambda c: f"concat('\"', replace(coalesce(CAST({c} AS STRING), ''), '\"', '\"\"'), '\"')"
    body = {
        "json": "to_json(named_struct('summary', named_struct('total_detections', total_detections, 'has_pii', has_pii, 'entity_counts', entity_counts), 'detections', detections))",
        "markdown": f"concat('# Scan\\n\\nDetections: ', total_detections, '\\n\\n', {listed(f'''concat('- ', {k}, ': ', entity_counts[{k}], '\\n')''')}, '\\n', {each(f'''concat({i} + 1, '. **', {d}.label, '** ', {d}.text, ' (', format_string('%.2f', {d}.score), ')\\n')''')})",
        "text": f"concat('SCAN\\nDetections: ', total_detections, '\\n', {listed(f'''concat(rpad({k}, 30, ' '), lpad(entity_counts[{k}], 6, ' '), '\\n')''')}, {each(f'''concat(lpad({d}.start, 8, ' '), lpad({d}.end, 8, ' '), ' ', rpad({d}.label, 30, ' '), {d}.text, '\\n')''')})",
        "html": f"concat('<h1>Scan</h1><ul>', {listed(f'''concat('<li>', {k}, ': ', entity_counts[{k}], '</li>')''')}, '</ul><ol>', {each(f'''concat('<li><b>', {d}.label, '</b> ', {safe(f'{d}.text')}, '</li>')''')}, '</ol>')",
        "csv": f"concat('start,end,label,score,source,text\\n', {each(f'''concat({d}.start, ',', {d}.end, ',', {cell(f'{d}.label')}, ',', format_string('%.2f', {d}.score), ',', {cell(f'{d}.source')}, ',', {cell(f'{d}.text')}, '\\n')''')})",
    }
    if fmt not in body:
        raise ValueError(f"no such format: {fmt}")
    return scans.select(id_, F.expr(body[fmt]).alias("report"))


def risk_summary(scans: DataFrame) -> DataFrame:
    """Documents by risk."""
    from .audit import risk

    return scans.groupBy(risk(F.col("total_detections"), F.map_keys("entity_counts")).alias("risk")).agg(F.count(F.lit(1)).alias("documents"))
