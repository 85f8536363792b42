"""Small tables at the edges: nulls, empty and very long texts, ties, repeated rows, clashing column names."""
LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod. " * 3000
COPY = " ".join(f"word{k}" for k in range(120))

EDGE = [
    (1, "The quick brown fox\njumps over the lazy dog", "src0"), (2, None, "src1"), (3, "", None), (4, "   \n\t ", "src1"), (None, "no id here", "src0"),
    (5, LONG, "src0"), (6, COPY, "src2"), (7, COPY, "src2"), (8, COPY + " tail", "src0"), (9, "one", "src0"), (9, "one", "src0"), (10, "Ünï ß é 日本 \U0001F600 token", None),
    (11, "<|endoftext|> marker", "src0")]

#: Names that the operators use themselves.
EXTRA = {"score": "1.5D", "n": "7", "key": "'k'", "h": "1", "rank": "2", "part": "3", "block": "4", "length": "5", "_slot": "6", "_block": "7", "_start": "8", "_chars": "'c'",
         "_key": "9", "_first": "1", "c0": "10", "_drop": "11", "_lines": "1", "rep": "12", "toxic": "1", "start": "0", "found": "true", "asks": "false", "d": "9"}


def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' AS lang", "cast(length(text) as long) AS n_chars", *[f"{v} AS `{k}`" for k, v in EXTRA.items()])


def none(spark):
    return edge(spark).filter("false")


def saved(spark, tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
