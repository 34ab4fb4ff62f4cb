"""An event catalog: domains, services and events described in the front matter of MDX files."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.parsers import front_matter, listed_id

ROW = "kind string, ord int, id string, name string, items array<string>, owners array<string>"
LISTS = {"domains": "services", "services": "sends", "events": None}


def find_catalog(root: str, name: str = "event-catalog") -> str | None:
    """The src directory of a catalog at ``root`` or one level below: a directory called ``name`` or ending in it."""
    base = Path(root)
    places = [base, *sorted(p for p in base.iterdir() if p.is_dir())] if base.is_dir() else []
    found = [p for p in places if p.name.endswith(name)] + [q for p in places for q in [p / name] if q.is_dir()]
    return next((str(p / "src") for p in found if (p / "src").is_dir()), None)


def catalog_files(root: str) -> list[tuple[str, int, str]]:
    """(kind, order, text) of every index.mdx; unreadable ones are left out."""
    rows = []
    for kind in LISTS:
        folder = Path(root) / kind
        for k, p in enumerate(sorted(folder.iterdir()) if folder.is_dir() else []):
            try:
                rows.append((kind, k, (p / "index.mdx").read_text(encoding="utf-8")))
            except OSError:
                continue
    return rows


def entries(texts: DataFrame) -> DataFrame:
    """(kind, ord, id, name, items, owners) of rows (kind, ord, text): items are the ids that a domain or service lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ROW)
    as_list = lambda v: v if isinstance(v, list) else []

    def run(batches):
        for batch in batches:
            rows = []
            for kind, k, text in zip(*(c.to_pylist() for c in batch.columns)):
                fm = front_matter(text or "")
                if not fm.get("id") or kind == "domains" and not fm.get("name"):
                    continue
                listed = as_list(fm.get(LISTS[kind])) if LISTS[kind] else []
                rows.append({"kind": kind, "ord": k, "id": fm["id"], "name": fm.get("name") or None, "items": [listed_id(i) for i in listed], "owners": as_list(fm.get("owners"))})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return texts.select("kind", "ord", "text").mapInArrow(run, schema)


def domain_rows(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'domains'").select("ord", "name", F.col("items").alias("services"))


def service_rows(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'services'").select("id", F.col("items").alias("events"))


def event_rows(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'events'").select(F.col("id").alias("catalog_id"), "owners")
