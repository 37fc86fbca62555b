"""Verb dictionaries as small static tables and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The verbs that name parts of a construction and those that connect them. objects and additions are the
# alternatives of a valence: what introduces it (one of several words, or a phrase), and the cases of its noun. entry: 0 the
# subject comes first, 1 either way, 2 the object comes first. approved: the verb alone tells that a part follows.
COMPOSITION = {
    "содержать": {"approved": True, "entry": 0, "objects": [{"anchors": [], "cases": ["Acc", "Nom"]}], "additions": [{"role": "ON", "anchors": ["на"], "cases": ["Loc"]}]},
    "оснащать": {"approved": True, "entry": 0, "objects": [{"anchors": [], "cases": ["Ins"]}]},
    "включать": {"approved": True, "entry": 1, "objects": [{"anchors": [], "cases": ["Acc", "Nom"]}, {"anchors": ["между", "с"], "cases": ["Ins"]}, {"anchors": ["в себя"], "cases": ["Acc"], "phrase": True}, {"anchors": ["в", "во"], "mandatory": False, "cases": ["Nom", "Acc"]}]},
    "иметь": {"approved": True, "entry": 0, "objects": [{"anchors": [], "cases": ["Acc", "Nom"]}]},
    "снабжать": {"approved": True, "entry": 0, "objects": [{"anchors": [], "cases": ["Ins"]}]},
    "вводить": {"approved": True, "entry": 1, "reversed": True, "objects": [{"anchors": ["в", "во"], "cases": ["Acc"]}, {"anchors": [], "cases": ["Nom"]}]},
    "состоять": {"approved": True, "entry": 0, "objects": [{"anchors": ["из"], "cases": ["Gen"]}]},
    "изготавливать": {"approved": True, "entry": 0, "objects": [{"anchors": ["из"], "cases": ["Gen"]}, {"anchors": ["в виде"], "cases": ["Gen"], "phrase": True}]},
    "составлять": {"approved": False, "entry": 0, "objects": [{"anchors": [], "cases": ["Acc"]}, {"anchors": ["из"], "cases": ["Gen"]}]},
    "выполнять": {"approved": True, "entry": 0, "objects": [{"anchors": ["в виде"], "cases": ["Gen", "Acc"], "phrase": True}, {"anchors": ["в", "во"], "cases": ["Loc"]}, {"anchors": ["на основе"], "cases": ["Acc", "Nom"], "phrase": True}, {"anchors": ["на"], "cases": ["Loc"]}, {"anchors": ["из"], "cases": ["Gen", "Acc"]}, {"anchors": ["с"], "cases": ["Ins"]}, {"anchors": [], "cases": ["Ins"]}]},
    "использоваться": {"approved": True, "entry": 1, "objects": [{"anchors": ["в"], "cases": ["Loc"]}]},
    "являться": {"approved": False, "entry": 1, "objects": [{"anchors": [], "cases": ["Ins"]}]},
    "служить": {"approved": False, "entry": 1, "objects": [{"anchors": [], "cases": ["Ins"]}]},
    "образовывать": {"approved": False, "entry": 0, "objects": [{"anchors": [], "cases": ["Acc", "Nom", "Ins"]}]},
    "добавлять": {"approved": False, "entry": 2, "reversed": True, "objects": [{"anchors": ["в", "во"], "cases": ["Loc"]}]},
    "помещать": {"approved": True, "entry": 1, "objects": [{"anchors": ["в", "на"], "cases": ["Loc"]}, {"anchors": [], "cases": ["Gen", "Acc"]}]},
    "укладывать": {"approved": True, "entry": 0, "objects": [{"anchors": ["в", "на"], "cases": ["Loc"]}]},
}
CONNECTION = {
    "устанавливать": {"approved": True, "entry": 1, "objects": [{"anchors": ["на"], "cases": ["Loc"]}, {"anchors": ["сверху"], "cases": ["Loc"]}, {"anchors": ["в"], "excepted": ["виде"], "cases": ["Loc", "Acc"]}]},
    "подключать": {"approved": True, "entry": 1, "objects": [{"anchors": ["к", "ко"], "cases": ["Dat"]}], "additions": [{"role": "VIA", "anchors": ["через"], "cases": ["Nom", "Acc"]}, {"role": "BY", "anchors": [], "cases": ["Ins"]}]},
    "подтягивать": {"approved": True, "entry": 1, "objects": [{"anchors": ["к", "ко"], "cases": ["Dat"]}], "additions": [{"role": "VIA", "anchors": ["через"], "cases": ["Nom", "Acc"]}, {"role": "BY", "anchors": [], "cases": ["Ins"]}]},
    "соединять": {"approved": True, "entry": 1, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}, {"anchors": [], "cases": ["Ins"]}, {"anchors": [], "cases": ["Nom", "Acc"]}], "additions": [{"role": "BY", "anchors": [], "cases": ["Ins"]}, {"role": "VIA", "anchors": ["через"], "cases": ["Nom", "Acc"]}]},
    "взаимодействовать": {"approved": True, "entry": 1, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}], "additions": [{"role": "BY", "anchors": [], "cases": ["Ins"]}, {"role": "VIA", "anchors": ["через"], "cases": ["Nom", "Acc"]}]},
    "скреплять": {"approved": False, "entry": 0, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}, {"anchors": [], "cases": ["Ins"]}], "additions": [{"role": "WHOM", "anchors": [], "cases": ["Acc"]}, {"role": "BY", "anchors": [], "cases": ["Ins"]}]},
    "крепиться": {"approved": True, "entry": 1, "objects": [{"anchors": ["к", "ко"], "cases": ["Loc", "Dat"]}], "additions": [{"role": "WHOM", "anchors": [], "cases": ["Acc"]}, {"role": "BY", "anchors": [], "cases": ["Ins"]}, {"role": "BY", "anchors": ["с помощью"], "cases": ["Gen"], "phrase": True}]},
    "согласовывать": {"approved": True, "entry": 1, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}], "additions": [{"role": "WHOM", "anchors": [], "cases": ["Acc"]}, {"role": "BY", "anchors": [], "cases": ["Ins"]}, {"role": "VIA", "anchors": ["через"], "cases": ["Nom", "Acc"]}]},
    "закреплять": {"approved": True, "entry": 1, "objects": [{"anchors": ["в", "на"], "cases": ["Loc"]}]},
    "пересекаться": {"approved": True, "entry": 1, "objects": [{"anchors": ["в", "на"], "cases": ["Loc"]}]},
    "связанный": {"approved": True, "entry": 1, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}], "additions": [{"role": "VIA", "anchors": ["через"], "cases": ["Acc", "Nom"]}, {"role": "BY", "anchors": [], "cases": ["Ins"]}]},
    "шунтировать": {"approved": False, "entry": 0, "objects": [{"anchors": [], "cases": ["Ins"]}]},
    "находиться": {"approved": False, "entry": 1, "objects": [{"anchors": ["на"], "cases": ["Loc"]}, {"anchors": ["в"], "cases": ["Loc"]}]},
    "надевать": {"approved": False, "entry": 1, "objects": [{"anchors": ["на"], "cases": ["Loc", "Acc"]}]},
    "размещать": {"approved": False, "entry": 1, "objects": [{"anchors": ["в", "на", "у"], "cases": ["Loc"]}]},
    "располагать": {"approved": True, "entry": 1, "objects": [{"anchors": ["внутри"], "cases": ["Gen", "Acc"], "phrase": True}, {"anchors": ["между"], "cases": ["Ins"]}, {"anchors": ["по"], "cases": ["Dat"]}, {"anchors": ["в"], "cases": ["Loc"]}, {"anchors": ["в контакте с"], "cases": ["Ins"], "phrase": True}]},
    "сообщаться": {"approved": True, "entry": 1, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}], "additions": [{"role": "VIA", "anchors": ["через"], "cases": ["Acc", "Nom"]}, {"role": "WHOM", "anchors": [], "cases": ["Acc"]}]},
    "сопряженный": {"approved": True, "entry": 1, "objects": [{"anchors": ["с", "со"], "cases": ["Ins"]}], "additions": [{"role": "VIA", "anchors": ["через"], "cases": ["Acc", "Nom"]}, {"role": "WHOM", "anchors": [], "cases": ["Acc"]}]},
    "открывать": {"approved": False, "entry": 0, "objects": [{"anchors": ["в", "во"], "cases": ["Acc"]}]},
    "изолировать": {"approved": False, "entry": 1, "objects": [{"anchors": [], "cases": ["Ins"]}], "additions": [{"role": "VIA", "anchors": ["от"], "cases": ["Gen"]}]},
}
SYNONYMS = {"установленный": "устанавливать", "образованный": "образовывать", "согласованный": "согласовывать", "сообщать": "сообщаться", "изолированный": "изолировать", "соединенный": "соединять", "уложенный": "укладывать"}
PREPOSITIONS = {"со": "с", "ко": "к", "во": "в", "надо": "над", "изо": "из", "об": "о", "обо": "об", "ото": "от"}
SEPARATORS = ("при этом", "а также", "а именно", "причем", "кроме того", "наоборот")
FACT_KEYWORDS = "уменьшение повышение увеличение улучшение разделение расширение обеспечение компенсация выполнение облучение реализация предотвращение снижение исключение ускорение создание препятствие стабилизация формирование устранение".split()


DROPPED_SEGMENTS = ("SEPARATOR", "PURPOSE", "NAMED")


def verbs() -> dict[str, dict]:
    """Lemma to its description; composition comes before connection."""
    valence = {"role": "OBJ", "phrase": False}
    return {
        lemma: {"lemma": lemma, "kind": kind, "reversed": False, **verb} | {side: [valence | v for v in verb.get(side, [])] for side in ("objects", "additions")}
        for kind, table in (("conn", CONNECTION), ("comp", COMPOSITION))
        for lemma, verb in table.items()
    }


VERBS = verbs()


def describe(lemma: str) -> dict | None:
    """What the dictionary has for a lemma or for what it is a synonym of."""
    return VERBS.get(SYNONYMS.get(lemma, lemma))


VALENCE = "array<struct<role:string,phrase:boolean,mandatory:boolean,excepted:array<string>,anchors:array<string>,cases:array<string>>>"


def verb_table(spark: SparkSession) -> DataFrame:
    names = ("lemma", "kind", "approved", "entry", "reversed", "objects", "additions")
    return spark.createDataFrame([tuple(v[n] for n in names) for v in VERBS.values()], f"lemma string, kind string, approved boolean, entry int, reversed boolean, objects {VALENCE}, additions {VALENCE}")


def lookup(df: DataFrame, value: str, first: DataFrame, second: DataFrame, synonyms: DataFrame, key: str, name: str) -> DataFrame:
    """Add name: what `first` has for the value (or for what it is a synonym of), else what `second` has. The three are small
    static tables of (key, ...): they are broadcast."""
    syn = synonyms.select(F.col("word").alias(value), F.col("stands_for").alias("__target"))
    df = df.join(F.broadcast(syn), value, "left").withColumn("__key", F.coalesce("__target", value)).drop("__target")
    for k, table in enumerate((first, second)):
        df = df.join(F.broadcast(table.select(F.col(key).alias("__key"), F.col(name).alias(f"__v{k}"))), "__key", "left")
    return df.withColumn(name, F.coalesce("__v0", "__v1")).drop("__key", "__v0", "__v1")


def unified_preposition(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PREPOSITIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)
