"""Small models and settings as files: tokenizers and language models in JSON, YAML settings (S-14 to S-16, K-09, K-15).

They are read and written through Spark's own file readers, so that their paths may be in any store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decoding import CharModel

BLANK = "<blank>"


def put(spark: SparkSession, text: str, path: str) -> None:
    """A text file of one part in the folder path."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def get(spark: SparkSession, path: str) -> str:
    """The text of the file, or of the one file in the folder, that path names."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path}: not one file")
    return found[0][0]


def save_tokenizer(spark: SparkSession, letters: str, path: str, blank: str = BLANK) -> None:
    """K-09: the ids of the blank (0) and of the letters in their order, both ways, with sorted keys."""
    if blank in letters or len(set(letters)) < len(letters):
        raise ValueError("letters repeat, or hold the blank's token")
    ids = {blank: 0, **{c: k for k, c in enumerate(letters, 1)}}
    data = {"blank_token": blank, "blank_id": 0, "vocab_size": len(ids), "char_to_id": ids, "id_to_char": {str(v): c for c, v in ids.items()}}
    put(spark, json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True), path)


def load_tokenizer(spark: SparkSession, path: str) -> str:
    """S-14: the letters in the order of their ids; raises unless these are 1, 2, 3 and so on."""
    data = json.loads(get(spark, path))
    ids = {str(c): int(k) for c, k in data["char_to_id"].items()}
    ids.pop(str(data.get("blank_token", BLANK)), None)
    if sorted(ids.values()) != list(range(1, len(ids) + 1)):
        raise ValueError(f"{path}: ids aren't 1 to {len(ids)}")
    return "".join(sorted(ids, key=ids.get))


def char_model(counts: DataFrame, order: int, k: float = 0.5) -> CharModel:
    """A model from counts (context, token, n), which are as many as an alphabet's n-grams, not as rows."""
    got: dict = {}
    for r in counts.collect():
        got.setdefault(r["context"], {})[r["token"]] = r["n"]
    return CharModel(got, order, k)


def save_model(spark: SparkSession, model: CharModel, path: str) -> None:
    """K-09."""
    put(spark, json.dumps({"order": model.order, "add_k": model.k, "vocab": sorted(model.known), "context_counts": model.counts}, ensure_ascii=False, indent=2, sort_keys=True), path)


def load_model(spark: SparkSession, path: str) -> CharModel:
    """S-15; a file without add_k has 0.5."""
    data = json.loads(get(spark, path))
    return CharModel({c: {t: int(n) for t, n in own.items()} for c, own in data["context_counts"].items()}, int(data["order"]), float(data.get("add_k", 0.5)))


def load_settings(spark: SparkSession, path: str) -> dict:
    """S-16: a YAML file that must hold a mapping."""
    import yaml

    data = yaml.safe_load(get(spark, path))
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not a mapping")
    return data


def patched(settings: dict, **changes) -> dict:
    """K-15: a copy with values put at dotted places (Global__epochs=3 is Global.epochs); others stay."""
    out = json.loads(json.dumps(settings))
    for name, value in changes.items():
        *way, last = name.split("__")
        at = out
        for step in way:
            at = at.setdefault(step, {})
        at[last] = value
    return out


def save_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """K-15."""
    import yaml

    put(spark, yaml.safe_dump(settings, allow_unicode=True, sort_keys=False), path)
