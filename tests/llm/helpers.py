"""Small documents tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = T.StructType([*SCHEMA.fields, *(T.StructField(n, T.StringType()) for n in ("fp", "bin", "label", "score", "start", "count", "component_id"))])


def documents(spark, texts, clashing=False, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    if clashing:
        return spark.createDataFrame([(*r, *"abcdefg") for r in rows], CLASHING)
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    long = " ".join(f"w{i}x" for i in range(30_000))
    docs = documents(spark, ["a b c d", None, "", "a b c d", long, "  \n\t ", "Ünï çödé ß 漢字 <|endoftext|> x", "one"], clashing=True)
    return docs.unionByName(docs.filter("doc_id in (0, 4)")).unionByName(docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:]).limit(1))
