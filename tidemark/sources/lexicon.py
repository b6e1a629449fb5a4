"""Lexicon files and folders of dictionaries, read into rows of terms. Files are JSON, or YAML where its library is at hand."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories of a lexicon, and the weight that a category has in a theme without weights.
CATEGORIES = ("brands", "features", "pain_points")
WEIGHTS = {"brands": 1.5, "features": 1.0, "pain_points": 1.2}
TERMS = "file string, theme string, layer string, category string, canonical string, aliases array<string>, precision string, weight double, polarity string, lifecycle string, error string"
_NAMES = [c.split()[0] for c in TERMS.split(", ")]


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("not JSON, and no library for YAML") from missing
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as broken:
            raise ValueError("neither JSON nor YAML") from broken


def _term(item: object, category: str, layer: str, aliases: Mapping, weight: float) -> dict | None:
    item = {"canonical": item} if isinstance(item, str) else item
    name = str(item.get("canonical") or "").strip() if isinstance(item, Mapping) else ""
    if not name:
        return None
    return {
        "category": category, "canonical": name, "aliases": [str(a) for a in item.get("aliases") or aliases.get(name) or []], "layer": str(item.get("layer") or layer),
        "precision": str(item.get("precision_tag") or ("exact" if category == "brands" else "phrase")), "weight": float(item.get("weight") or weight or 1.0),
        "polarity": None if item.get("polarity") is None else str(item["polarity"]), "lifecycle": str(item.get("lifecycle") or "approved"),
    }


def lexicon_terms_of(data: object) -> Iterator[dict]:
    """Terms of a file by layers, or else by themes; items that are neither a text nor a mapping with ``canonical`` are left out."""
    data = data if isinstance(data, Mapping) else {}
    if isinstance(data.get("layers"), Mapping) and data["layers"]:
        for layer, content in data["layers"].items():
            for category in CATEGORIES if isinstance(content, Mapping) else ():
                for item in content.get(category) or []:
                    if isinstance(item, Mapping) and (found := _term(item, category, str(layer), {}, 1.0)):
                        yield found
        return
    for theme, content in (data.get("themes") or {}).items():
        weights, aliases = content.get("weights") or WEIGHTS, content.get("aliases") or {}
        for category in CATEGORIES:
            for item in content.get(category) or []:
                if found := _term(item, category, str(content.get("default_layer") or "L2"), aliases, float(weights.get(category, 1.0))):
                    yield found | {"theme": str(theme)}


def _folder_terms(categories: Mapping[str, str], allowed: frozenset[str]):
    def of(data: object) -> Iterator[dict]:
        for category, items in data.items() if isinstance(data, Mapping) else ():
            name = categories.get(str(category).lower(), str(category))
            if name.lower() in allowed and isinstance(items, list):
                for item in items:
                    if isinstance(item, str) and item.strip():
                        yield {"category": name, "canonical": item.strip(), "aliases": []}

    return of


def _read(of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [r | {"file": file} for r in of(_parsed(text or ""))]
                except (ValueError, AttributeError, TypeError) as broken:
                    rows.append({"file": file, "error": str(broken)[:200]})
            kinds = {"aliases": pa.list_(pa.string()), "weight": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in _NAMES], _NAMES)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms of the lexicon files at ``path``, as TERMS; a file that can't be read gives one row with ``error``."""
    return _files(spark, path).mapInArrow(_read(lexicon_terms_of), TERMS)


def read_dictionaries(spark: SparkSession, path: str, categories: Mapping[str, str], allowed: list[str]) -> DataFrame:
    """category and canonical of a folder of files {category: [entities]}, each once over all files.

    ``categories`` maps other names of categories, in lower case, to those that are ``allowed``; others are left out. Broken files are, too.
    """
    found = _files(spark, path).mapInArrow(_read(_folder_terms(dict(categories), frozenset(a.lower() for a in allowed))), TERMS)
    return found.filter("error IS NULL").select("category", "canonical").distinct()


def names(terms: DataFrame) -> DataFrame:
    """category, canonical, term of ``terms`` (category, canonical, aliases): a row for the canonical name and each alias."""
    every = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return terms.filter("canonical IS NOT NULL").select("category", "canonical", F.explode(every).alias("term"))
