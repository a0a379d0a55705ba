import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plain import prose  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns that operators use themselves
EXTRA = ["n_words", "row_", "size", "digest", "kept", "others_", "fingerprint", "copies", "bucket", "gone"]


def corpus() -> list[tuple]:
    """Nulls everywhere, empty, blank and very long texts, exact and near copies, shared passages and lines, repeated rows."""
    passage, rows = " ".join(prose(900, 70)), []
    shared = "\n".join(" ".join(prose(910 + i, 12)) for i in range(6))
    for i in range(70):
        text = " ".join(prose(i, 60 + i)) + "\n" + " ".join(prose(1000 + i, 30))
        if i % 3 == 0:
            text = " ".join(prose(2000 + i, 20)) + f" {passage} " + text
        if i % 4 == 0:
            text += "\n" + shared + "\n" + " ".join(prose(3000 + i, 15))
        if i % 9 == 0:
            text += "\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."
        rows.append((i, text, ("en", "fr", None)[i % 3], (f"s{i % 5}" if i % 7 else None), len(text)))
    rows += [(100 + i, rows[5][1], "en", "s0", 1) for i in range(12)]
    rows += [(120 + i, rows[5][1].replace(" ", "  ", 3), "en", "s0", 1) for i in range(3)]
    near = prose(77, 400)
    rows += [(130 + i, " ".join([*near[:200 + i], "changed", *near[201 + i:]]), "fr", "s1", 1) for i in range(10)]
    rows += [(150, None, None, None, None), (151, "", "en", "s1", 0), (152, " \n\t ", "en", "s2", 4), (153, "One", "en", "s3", 3), (154, "two Words", None, "s4", 9)]
    rows += [(160, "\n".join([" ".join(prose(50 + k, 25)) for k in range(900)]) + " " + "x" * 70000, "en", "s1", 1)]
    rows += [(170, "gnu general public license <|endoftext|> It's 42 CAFÉ́    x", "en", "s2", 1), (171, "%%% ||| ### " * 60, "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The corpus as a table, with extra columns whose names clash with working names; read from files, as operators ask."""
    from blocklens.session import ship_package
    ship_package(spark)
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    df = spark.createDataFrame(rows, DOCS)
    df.selectExpr("*", *[f"cast(doc_id as string) as {c}" for c in EXTRA]).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return docs.limit(0)
