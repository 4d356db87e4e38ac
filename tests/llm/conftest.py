import re

import pytest


@pytest.fixture(scope="session")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), with extra columns whose names clash with the operators' own."""
    def build(rows, extra=True):
        ddl = "doc_id long, text string, lang string"
        rows = [(i, t, "en") for i, t in rows]
        if extra:
            names = "row key spans fp root verdict bits threshold slot_hit first_doc cut label toxic score component_id".split()
            ddl += "".join(f", {n} string" for n in names)
            rows = [(*r, *[f"x{k}" for k in range(len(names))]) for r in rows]
        return spark.createDataFrame(rows, ddl)

    return build


@pytest.fixture(scope="session")
def words():
    return lambda text: re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
