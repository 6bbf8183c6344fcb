"""Cleaned text of all documents against html.unescape and re."""

import hashlib
import re
from html import unescape

from homeledger.plans import queries as core


def cleaned(text):
    if text is None:
        return None
    text = re.sub(r"\n\s+", "\n", re.sub(r"[ \t\r\f\v]+", " ", unescape(text).replace("\xa0", " "))).strip()
    return hashlib.sha256(text.encode()).hexdigest() if text else None


def test_clean_text_whole(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = [(-1, None), (-2, "&amp;"), (-3, " a&nbsp;&nbsp;b \n\t &lt;c&#62; &eacute;&bogus; "), (-4, "&#32;\n&nbsp;"), (-5, "&amp;amp;")]
    rows = given.unionByName(spark.createDataFrame(more, given.schema))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in core.queries()["clean_text"](spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: cleaned(r.text) for r in rows.collect()}
