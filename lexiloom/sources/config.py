"""Small configuration files: dictionaries by speaker, rules, phone groups, topologies, settings, speaker tables.

They are read by Spark's text reader from any store, parsed on the driver, and become small tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _yaml(spark: SparkSession, path: str):
    import yaml

    return yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def speaker_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """speaker, dictionary, kind: speaker, default or nonnative (speaker null for the last two)."""
    rows = [
        (None if name in ("default", "nonnative") else str(name), str(value), name if name in ("default", "nonnative") else "speaker")
        for name, value in (_yaml(spark, path) or {}).items()
    ]
    return spark.createDataFrame(rows, "speaker string, dictionary string, kind string")


def dictionary_of(utterances: DataFrame, table: DataFrame) -> DataFrame:
    """utterances with the dictionary of their speaker, the default one for others."""
    own = table.where("kind = 'speaker'").select("speaker", "dictionary")
    default = table.where("kind = 'default'").agg(F.max("dictionary").alias("_default"))
    joined = utterances.join(F.broadcast(own), "speaker", "left").crossJoin(F.broadcast(default))  # both from one small file
    return joined.withColumn("dictionary", F.coalesce("dictionary", "_default")).drop("_default")


RULE = ("segment", "preceding_context", "following_context", "replacement")


def phonological_rules(spark: SparkSession, path: str, dialects: list[str] | None = None) -> DataFrame:
    """dialect and the fields of RULE: rules for all, once for each dialect, and each dialect's own."""
    body = _yaml(spark, path) or {}
    own = body.get("dialects") or {}
    names = list(dict.fromkeys([*(dialects or []), *own])) or ["default"]
    rows = [(d, *(str(r.get(k) or "") for k in RULE)) for d in names for r in [*(body.get("rules") or []), *(own.get(d) or [])]]
    return spark.createDataFrame(rows, "dialect string, " + ", ".join(f"{k} string" for k in RULE))


def rule_tuples(rules: DataFrame, dialect: str) -> list[tuple[str, str, str, str]]:
    """The rules of a dialect as operators.lexicon takes them."""
    return [tuple(r) for r in rules.where(F.col("dialect") == dialect).select(*RULE).collect()]


def phone_groups(spark: SparkSession, path: str) -> DataFrame:
    """phone_group, place, phone from a list of lists or named lists."""
    body = _yaml(spark, path) or []
    named = body.items() if isinstance(body, dict) else ((str(k), x) for k, x in enumerate(body))
    return spark.createDataFrame([(str(g), k, str(p)) for g, phones in named for k, p in enumerate(phones)], "phone_group string, place int, phone string")


def phone_topologies(spark: SparkSession, path: str, states: tuple[int, int] = (3, 3)) -> DataFrame:
    """phone, min_states, max_states; what a phone leaves out has the default."""
    rows = [(str(p), int((v or {}).get("min_states", states[0])), int((v or {}).get("max_states", states[1]))) for p, v in (_yaml(spark, path) or {}).items()]
    return spark.createDataFrame(rows, "phone string, min_states int, max_states int")


def speaker_info(spark: SparkSession, path: str) -> DataFrame:
    """A tab separated table of speakers without a header: speaker, then fields f1, f2, .. as they are."""
    rows = spark.read.option("sep", "\t").csv(path)
    return rows.toDF("speaker", *(f"f{k}" for k in range(1, len(rows.columns))))


def corpus_description(spark: SparkSession, path: str) -> DataFrame:
    """A corpus description (one JSON object over several lines)."""
    return spark.read.option("multiLine", "true").json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, or the first field of a dictionary's lines; lower case, without repeats."""
    word = F.lower(F.get(F.split(F.trim("value"), r"\s+"), 0))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def settings(spark: SparkSession, path: str, defaults: dict | None = None) -> tuple[dict, list[dict]]:
    """(flat settings over the defaults, training stages in order) of a configuration; a setting that the defaults lack raises."""
    body = _yaml(spark, path) or {}
    stages = [{"stage": name, **(values or {})} for entry in body.pop("training", []) or [] for name, values in entry.items()]
    if defaults is not None and (unknown := set(body) - set(defaults)):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return {**(defaults or {}), **body}, stages


def dataset_kind(spark: SparkSession, path: str) -> str:
    """What a folder holds: a stored ``database`` of Parquet tables, a ``corpus`` of text or sound files, or nothing (``none``)."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return "none"
    names = [x.getPath().getName().lower() for x in store.listStatus(place)]
    if any(x.endswith(".parquet") for x in names):
        return "database"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = files.where(F.lower("path").rlike(r"\.(lab|txt|textgrid|wav|flac|ogg|mp3|aiff|opus)$")).limit(1).count()
    return "corpus" if found else "none"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Embeddings as write_vectors leaves them."""
    return spark.read.parquet(path)


def model_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata object of a model."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) or "{}")
