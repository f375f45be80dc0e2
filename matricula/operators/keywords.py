"""Search for a whole table of keywords at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.scratch import materialize

#: Bytes of keywords that one automaton holds, which is broadcast; a larger table is searched in parts.
PART_BYTES = 8 << 20


def keyword_hits(texts: DataFrame, key: str, text: str, keywords: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """key and keyword_id of each keyword that occurs in a row's normalised text (lower case, runs of
    white space as one blank), once a row.

    keywords: keyword_id, keyword. An Aho-Corasick automaton of all normalised keywords passes once
    over each text, whose cost thus follows the text and not the number of keywords. A table of more
    than `part_bytes` is dealt by hash into parts, each with a pass of its own. Null texts and null or
    blank keywords meet nothing; keywords that are equal when normalised are reported each; of rows
    that repeat a key each is searched.
    """
    spark = texts.sparkSession
    plain = keywords.select(F.col("keyword_id"), normalize("keyword").alias("plain")).filter("plain <> ''")
    grouped = materialize(plain.groupBy("plain").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("plain")))
    named = materialize(plain.withColumn("h", F.xxhash64("plain")))
    total = grouped.agg(F.sum(F.octet_length("plain") + 16)).first()[0] or 0
    parts = -(-total // part_bytes)
    source = texts.select(key, normalize(text).alias("plain")).filter("plain is not null")
    found = None
    for k in range(parts):
        words = [r["plain"] for r in grouped.filter(F.pmod("h", F.lit(parts)) == k).select("plain").collect()]  # about part_bytes
        hits = _search(source, key, spark.sparkContext.broadcast(words))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(key, F.lit(None).cast(keywords.schema["keyword_id"].dataType).alias("keyword_id")).filter(F.lit(False))
    return found.join(named.select("plain", "keyword_id"), "plain").select(key, "keyword_id")


def _search(source: DataFrame, key: str, words) -> DataFrame:
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("plain").to_pylist()):
                hits = {w for _, w in automaton.iter(text)}
                rows += [i] * len(hits)
                found += hits
            yield pa.record_batch([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [key, "plain"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, plain string")
