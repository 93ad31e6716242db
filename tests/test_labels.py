"""Labels of whole texts against plain Python."""

import re
import unicodedata

from emberframe.plans.catalog import QUERIES


def brute(text):
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().casefold()
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def test_whole_texts(spark, tmp_path):
    """Every line, and what follows the 80th character, is in the label."""
    texts = ["First LINE\nSegúndo: línea\n\n  third – ß, ñ", "é" * 79 + " Über-Ärger " + "x, y; " * 400 + "\nlast", "", "\n\n---\nonly Here\n", "a\r\nb\tc"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.label for r in QUERIES["label_normalise"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in rows}
