import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, long words, ties, repeated rows, and columns named like added ones."""
    line = "the same line of words"
    rows = [(i, f"{line}\n  {line.upper()}\t\nline {i} of its own words here", "en", f"s{i % 4}", 1) for i in range(14)]
    rows += [(20, None, None, None, None), (21, "", "en", "s1", 0), (22, " \t\n\x0b\r ", "en", "s1", 3), (None, "no id at all", None, "s2", 1)]
    rows += [(23, "x" * 5000 + " " + "é" * 3000, "fr", "s3", 8001), (24, "twice", "en", "s1", 5), (24, "twice", "en", "s1", 5)]
    rows += [(25, "ab " * 4000, "en", "", 1), (26, "ZÉRO zéro ı İ   \x1c \x85 end</s>", "fr", "ω", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'extra' as size", "1 as score", "array(1) as ids", "'x' as shard", "7 as n_lines", "'f' as fingerprint", "'o' as out", "0 as copies")


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """odd_docs with columns named like helpers of the operators; `mark` tells the rows apart by their content."""
    names = ["_key", "_bucket", "_take", "_copy", "_place", "own_id", "own_md5", "row", "row_id", "key", "bucket", "record", "firsts", "n", "take", "place", "one", "all", "digest", "decoded", "a.b"]
    return odd_docs.selectExpr("*", "md5(concat_ws('|', doc_id, text)) as mark", *[f"concat('{x}', coalesce(doc_id, -1)) as `{x}`" for x in names])
