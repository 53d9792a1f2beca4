"""Small tables with the cases that operators must bear, and documents with planted copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def planted(seed=1, n=40):
    """Clean documents, exact copies, near copies, a shared passage, and hard cases."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(n)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    add = lambda t, source="src0": rows.append((len(rows), t, "en", source, len(t or "")))
    add(texts[3])
    add(texts[3])
    words = texts[5].split()
    add(" ".join([*words[:30], "changed", *words[31:]]))
    for i in (6, 7, 8):
        add(f"{prose(rng, 40)} {passage} {prose(rng, 40)}")
    add(None, None)
    add("")
    add(" \t\n\u000b ")
    add("Ünïcödé Ωmega \u00a0 nbsp 日本語 " * 20, None)
    add("one two")
    add("same line\n" * 30)
    add(prose(rng, 20000))
    return rows


def table(spark, rows, extra=()):
    """rows as documents, with extra columns that clash with names that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("own"))
    return df


def write(spark, folder, name, df):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
