"""Brute-force helpers shared by the tests of the training-data operators."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_df(spark, rows):
    """(doc_id, text) rows with two extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, hash int")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
