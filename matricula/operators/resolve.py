"""Entity resolution: institution names against a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from ..functions.text import jaccard, normalize
from ..sources.scratch import materialize
from .registry import first_by

#: Points for a name, an alias and an acronym, from equal to similar.
NAME, ALIAS, ACRONYM = (100, 80, 60, 40), (90, 50, 30), (95, 70)
ACTIVE, EDUCATION, SIMILAR = 10, 5, 0.7
#: Queries of the loose mode that are broadcast to the registry at once.
MOST_LOOSE = 1000


def _alike(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))) >= SIMILAR


def match_score(query: Column, strict: bool = True) -> Column:
    """Points of a registry row (name, aliases, acronyms, status, types) for a normalised query.

    Of aliases and acronyms the first that hits counts. Unless one of the three hits, a row gets
    nothing (`strict`), or only what its status and type give.
    """
    name = normalize("name")
    by_name = F.when(query == name, NAME[0]).when(F.contains(name, query), NAME[1]).when(F.contains(query, name), NAME[2]).when(_alike(query, name), NAME[3]).otherwise(0)
    either = lambda a: F.contains(a, query) | F.contains(query, a)
    alias = lambda a: F.when(query == a, ALIAS[0]).when(either(a), ALIAS[1]).when(_alike(query, a), ALIAS[2]).otherwise(0)
    acronym = lambda a: F.when(query == a, ACRONYM[0]).when(either(a), ACRONYM[1]).otherwise(0)
    first_hit = lambda column, points: F.coalesce(F.get(F.filter(F.transform(column, lambda a: points(normalize(a))), lambda p: p > 0), F.lit(0)), F.lit(0))
    named = by_name + first_hit("aliases", alias) + first_hit("acronyms", acronym)
    kind = F.when(F.col("status") == "active", ACTIVE).otherwise(0) + F.when(F.array_contains("types", "Education"), EDUCATION).otherwise(0)
    return F.when(named > 0, named + kind).otherwise(F.lit(0) if strict else kind)


def candidates(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs (query, id) that can score, found without losing one by three equi-joins.

    Where one string holds the other, all three-letter pieces of the shorter one are in the longer:
    it is enough that they meet in the shorter one's rarest piece. Strings that share enough of
    their words meet in one of the query's rarest words, as many as may be missing and one more.
    Strings of one or two letters are pieces of themselves. Rarity is counted over the registry.
    """
    sizes = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - 2, F.lit(1))), lambda i: F.substring(n, i, F.lit(3)))
    brief = lambda n: F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.when(F.length(n) >= k, F.transform(F.sequence(F.lit(1), F.length(n) - k + 1), lambda i: F.substring(n, i, k))).otherwise(F.array().cast("array<string>"))))
    pieces = lambda n: F.array_distinct(F.when(F.length(n) < 3, F.array(n)).otherwise(sizes(n)))
    all_pieces = lambda n: F.array_distinct(F.concat(sizes(n), brief(n)))
    words = lambda n: F.array_distinct(F.split(n, " "))
    q = queries.select("query", normalize("query").alias("n")).distinct().filter("n <> ''")
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("acronyms", F.array().cast("array<string>")))
    named = materialize(registry.select("id", F.explode(every).alias("n")).select("id", normalize("n").alias("n")).filter("n <> ''").distinct())
    held = materialize(named.select("id", F.explode(all_pieces(F.col("n"))).alias("piece")).distinct())
    often = materialize(held.groupBy("piece").agg(F.count(F.lit(1)).alias("often")))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        each = rows.select(key, "n", F.explode(pieces(F.col("n"))).alias("piece")).join(often, "piece", "left")
        return each.groupBy(key, "n").agg(F.min_by("piece", F.struct(F.coalesce("often", F.lit(0)), "piece")).alias("piece")).select(key, "piece").distinct()

    inside = rarest(q, "query").join(held, "piece").select("query", "id")
    asked = q.select("query", F.explode(all_pieces(F.col("n"))).alias("piece"))
    around = rarest(named, "id").join(asked, "piece").select("query", "id")
    said = named.select("id", F.explode(words(F.col("n"))).alias("word")).distinct()
    common = said.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    ranked = q.select("query", F.size(words(F.col("n"))).alias("size"), F.explode(words(F.col("n"))).alias("word")).join(common, "word", "left")
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.coalesce("often", F.lit(0)), "word")))
    telling = ranked.filter(F.col("place") <= F.col("size") - F.ceil(SIMILAR * F.col("size")) + 1)
    alike = telling.join(said, "word").select("query", "id")
    return inside.unionByName(around).unionByName(alike).distinct()


def resolve(queries: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """The best registry row of each query (query), the earlier one on ties; none if none scores.

    registry: id, pos, name, aliases, acronyms, status, types.
    """
    asked = queries.select("query").distinct()
    if strict:
        return _best(candidates(asked, registry), registry, strict)
    blocks = max(1, -(-asked.count() // MOST_LOOSE))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))))
    out = None
    for k in range(blocks):  # about MOST_LOOSE queries at once, each block against all rows
        some = F.broadcast(asked.filter(F.col("block") == k).select("query"))
        found = _best(registry.select("id").join(some, F.lit(True)), registry, strict)
        out = found if out is None else out.unionByName(found)
    return out


def _best(pairs: DataFrame, registry: DataFrame, strict: bool) -> DataFrame:
    scored = pairs.join(registry, "id").withColumn("score", match_score(normalize("query"), strict)).filter("score > 0")
    return first_by(scored, ["query"], F.desc("score"), F.asc("pos"), F.asc("id"))


def crosswalk(resolved: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the other scheme's id (ror_id -> openalex_id), null where it is unknown."""
    return resolved.join(ids, "ror_id", "left")
