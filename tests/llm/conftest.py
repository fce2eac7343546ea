import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_small():
    """Rows of the smallest documents table, with cases that any text column can hold."""
    import duckdb
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    text = dict(rows)
    return rows + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, " \n"), (9005, text[3]),
                   (9006, "b" * 51 + text[7] + "b" * 51), (9006, "b" * 60), (9007, "a" * 500), (9008, "a" * 70),
                   (9009, text[5].upper()), (9010, "x" + text[5]), (9011, "é" * 40 + "日本" * 30), (9011, "é" * 40 + "日本" * 30)]
