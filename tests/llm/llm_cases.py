"""Awkward rows that every operator over documents has to take."""

LONG = " ".join(f"w{i % 997}" for i in range(30_000))

ROWS = [
    (1, "the cat sat on the mat and looked at the dog for a long long while today", "en", "a"),
    (2, "the cat sat on the mat and looked at the dog for a long long while today", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n", "fr", "b"),
    (6, "mot", "fr", "b"),
    (7, LONG, "en", "b"),
    (8, "Ünïcödé wörter hier.  und <|endoftext|> 123", "de", None),
    (9, "preface words then the cat sat on the mat and looked at the dog for a long long while today", None, "c"),
    (9, "preface words then the cat sat on the mat and looked at the dog for a long long while today", None, "c"),
    (None, "a row without an id", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS):
    """With columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("fp", "key", "size", "b", "component_id", "data", "score", "node", "length"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)
