import pytest

NAMES = ("k", "h", "n", "c", "row", "spans", "prefix", "score", "lang_pred", "length", "part", "rank", "count")


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with every awkward case: null and empty texts, null and repeated ids,
    equal rows, one very long text, and further columns of clashing names."""
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    base = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(60))
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, base.upper(), "en"),
        (4, "head one " + base + " tail", "en"),
        (5, None, None),
        (6, "", "de"),
        (7, " \n\t ", "de"),
        (8, "one", "fr"),
        (9, "one", "fr"),
        (10, "one two three", None),
        (11, "... !!! 123 ###", "en"),
        (12, "ab" * 900, "en"),
        (None, "no id here " + base, "en"),
        (None, None, None),
        (13, "same row", "en"),
        (13, "same row", "en"),
        (13, "other text under one id", "en"),
        (14, long, "en"),
        (15, "start " + long[40_000:90_000] + " end", "en"),
        (16, "élan ünïcode ßtraße — “quotes” 你好 " * 40, "fr"),
        (17, "élan ünïcode ßtraße — “quotes” 你好 " * 40 + "x", "fr"),
        (18, "<|endoftext|> <|ENDOFTEXT|> <b>Bold.</b> it's WE'LL end.. a,b", "en"),
        (2**40, "far id", "en"),
    ]
    df = spark.createDataFrame([(*r, "src", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
