"""Writers: manifests as JSON lines and CSV by Spark, reports as JSON, Markdown and HTML by the driver."""

from __future__ import annotations

import base64
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.schema import MANIFEST


#: Spark trims fields when it writes CSV and guesses the line end when it reads it, unless told otherwise.
_CSV = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; nulls are written."""
    rows.select(sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines, by its schema; blank lines are passed over."""
    return spark.read.schema(MANIFEST).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; captions in one field, between bars. Every field is quoted and keeps the white space at its ends."""
    rows.withColumn("captions", F.concat_ws(" || ", "captions")).write.mode("overwrite").options(**_CSV, quoteAll=True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote, as strings; lines end where it ended them, whatever line ends lie inside fields."""
    return spark.read.options(**_CSV, multiLine=True).csv(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors and ranked hits as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def write_json(path: str | Path, payload: dict, sort: bool = True) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=sort, default=str) + "\n", encoding="utf-8")


def write_markdown(path: str | Path, title: str, sections: dict[str, dict | list | str]) -> None:
    """A heading, and for each section a table of names and values, a list or a paragraph."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, dict):
            out += ["| Name | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in body.items())]
        elif isinstance(body, list):
            out += [f"- {x}" for x in body] or ["None."]
        else:
            out.append(str(body))
        out.append("")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(out), encoding="utf-8")


def thumbnail(content: bytes, kind: str = "jpeg") -> str:
    """An image file as a data URI; the browser scales it."""
    return f"data:image/{kind};base64,{base64.b64encode(content).decode()}"


def write_html(path: str | Path, title: str, cards: list[dict]) -> None:
    """A page of cards: heading, lines (escaped) and, if given, an image as data URI."""
    body = []
    for c in cards:
        image = f'<img alt="" width="224" src="{c["image"]}">' if c.get("image") else ""
        body.append(f"<section><h2>{html.escape(str(c['heading']))}</h2>{image}<ul>" + "".join(f"<li>{html.escape(str(x))}</li>" for x in c["lines"]) + "</ul></section>")
    page = f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>' + "".join(body)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page, encoding="utf-8")


def smoke_cards(rows: list, shown: int = 5) -> list[dict]:
    """Cards of sampled manifest rows: the first captions and the beginning of the digest."""
    return [{"heading": r["image_id"], "lines": [f"split {r['split']}, class {r['class_name']}, {r['width']} x {r['height']}, sha256 {r['sha256'][:16]}", *r["captions"][:shown]]} for r in rows]
