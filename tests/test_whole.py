"""Queries take every row of their tables."""

import unicodedata

from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import modules as mo
from quarrymill.plans import catalog, more, reports, stored, tickets  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_sections_of_every_document(spark):
    rows = catalog.QUERIES["all_sections"](spark, SF)
    want = catalog.md_lines(spark, SF).where("text like '#%' and text not like '%Deep%'")
    assert rows.count() == want.count() and {r.docno for r in rows.collect()} == {r.docno for r in want.select("docno").distinct().collect()}
    assert sorted(r[:3] for r in rows.collect()) == sorted(tuple(r) for r in catalog.QUERIES["reserved_sections"](spark, SF).collect())
    assert rows.where(F.col("docno") % 10 != 0).count() > rows.where("reserved").count()


def repaired(text):
    """(normal text, repairs) character by character, from unicodedata."""
    out = []
    for ch in "".join(tx.PRIVATE_SYMBOLS.get(ord(ch), ch) for ch in text):
        o, new = ord(ch), unicodedata.normalize("NFKC", ch)
        if 0xE000 <= o <= 0xF8FF:
            continue
        if 0x2E80 <= o <= 0x2FDF:
            out.append(new if len(new) == 1 and not 0x2E80 <= ord(new) <= 0x2FDF else tx.RADICALS.get(o, ch))
        else:
            out.append(new if len(new) == 1 and ch not in tx.WIDE_MARKS else ch)
    return "".join(out), sum(0x2E80 <= ord(c) <= 0x2FDF or 0xE000 <= ord(c) <= 0xF8FF for c in text)


def test_normalised_takes_every_document(spark, tmp_path):
    texts = ["plain", "caf\u00e9", "\uff21\uff11\uff05\uff0c", "\u2ecb\u2f42", "a\ue000b\uf0b7", "a \u2013 \u201cb\u201d", "\u6f22\u5b57", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.normal, r.repairs) for r in catalog.QUERIES["normalised"](spark, str(tmp_path)).collect()}
    odd = "".join(chr(a) for a, _ in catalog.REPAIRED)
    assert got == {i: (None, None) if t is None else repaired(t + odd) for i, t in enumerate(texts)}


def test_dir_stats_counts_lines_of_every_file(spark):
    files = spark.range(1000).select(F.format_string("a/f%04d", "id").alias("rel"), F.when(F.col("id") % 4 == 0, 2_000_000).otherwise(10).alias("size"), F.lit(2).alias("loc"))
    (r,) = mo.dir_stats(files).collect()
    assert (r.dir, r.files, r.bytes, r.loc, r.loc_approx) == ("a", 1000, 250 * 2_000_000 + 7500, 1500, False)
