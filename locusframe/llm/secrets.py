"""Secret scan with corpus-wide ownership frequency, in DataFrame functions throughout.

Patterns find candidates; the hash of a candidate's value is counted over the distinct owners and repositories
that hold it.  A value that several owners hold is a widely copied example; one that stays with its owner and
looks random is reported as a live-looking credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm import spans as sp
from locusframe.llm.scratch import Scratch

ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "live")
#: Values that hold 1 / HOT_SHARE of all candidates or more are broadcast: HOT_SHARE rows at most.
HOT_SHARE = 1000


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, failing matches dropped. A hex or access match below its least length
    cannot hide a longer one, as both patterns take whole runs, so the length stands in the pattern."""
    assign = F.filter(sp.matches(text, ASSIGN, "assign", 0, group=1), lambda s: F.length(s["value"]) >= 6)
    access = sp.matches(text, ACCESS, "access", 1, probe=F.contains(text, F.lit("AKIA")))
    return F.concat(assign, access, sp.matches(text, HEX, "hex", 2))


def _bits(value: Column) -> Column:
    """Shannon entropy of the characters, bits each."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def candidates(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), base_spans(text).alias("base"))
    return scratch.cut(rows, "spans")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_occurrences, n_repos, n_owners) of each candidate value.

    Counted in two steps, first distinct (value, owner, repository), so a value in a third of all documents is
    combined before its shuffle.  A null owner or repository counts as one of its own.
    """
    each = found.select("owner", "repo", F.explode("base").alias("s")).groupBy(F.sha2("s.value", 256).alias("value_hash"), "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    per_owner = each.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"))
    per_repo = each.groupBy("value_hash", "repo").agg(F.count(F.lit(1)).alias("x"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_owners")).join(per_repo.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repos")), "value_hash")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 1, max_repos: int = 3, min_bits: float = 2.5, name: str = "secrets") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) for each row of docs.

    spans holds the base spans (kind:start:end, code points, end exclusive) and one ``live`` span over the value
    of each candidate that at most max_owners owners and max_repos repositories hold and whose characters have
    min_bits of entropy; n_copied counts the base spans of values held more widely.  repo_col defaults to the id:
    each document is a repository of its own.  A null text is empty; rows that repeat an id are judged by their own
    text; null owners count as one owner; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, name)
    found = candidates(docs, scratch, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col or id_col)
    held = scratch.cut(ownership(found), "held")
    live = F.when((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos), F.lit(True)).otherwise(F.lit(False))
    held = held.select("value_hash", live.alias("own"), "n_occurrences")
    # a value of at least 1 / HOT_SHARE of all candidates is hot: there are HOT_SHARE such at most, which go to the rows
    least = F.lit((held.agg(F.sum("n_occurrences")).first()[0] or 0) / HOT_SHARE)
    hot, cold = held.where(F.col("n_occurrences") >= least).drop("n_occurrences"), held.where(F.col("n_occurrences") < least).drop("n_occurrences")
    each = found.where(F.size("base") > 0).select("id", "key", F.explode("base").alias("s")).distinct().withColumn("value_hash", F.sha2("s.value", 256))
    tagged = each.join(F.broadcast(hot.select(F.col("value_hash").alias("h"), F.col("own").alias("hot_own"))), F.col("value_hash") == F.col("h"), "left").drop("h")
    each = tagged.where("hot_own is not null").withColumnRenamed("hot_own", "own").unionByName(tagged.where("hot_own is null").drop("hot_own").join(cold, "value_hash"))
    span = F.struct((F.col("s.end") - F.length("s.value")).alias("start"), F.lit(3).alias("kind_no"), F.col("s.end").alias("end"), F.lit("live").alias("kind"), F.lit(None).cast("string").alias("value"))
    judged = each.groupBy("id", "key").agg(F.collect_set(F.when(F.col("own") & (_bits(F.col("s.value")) >= min_bits), span)).alias("live"), F.count_if(~F.col("own")).alias("n_copied"))
    judged = judged.select(F.col("id").alias("i"), F.col("key").alias("k"), "live", "n_copied")
    has = F.size("base") > 0
    # rows without candidates meet nothing: their key is null and stays out of the join's shuffle groups
    out = found.withColumn("jk", F.when(has, F.col("key"))).join(judged, F.col("id").eqNullSafe(F.col("i")) & (F.col("jk") == F.col("k")), "left")
    every = F.concat("base", F.coalesce(F.col("live"), F.array().cast(sp.SPAN)))
    return out.select(
        F.col("id").alias(id_col), *[sp.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(sp.rendered(F.col("base")), 256).alias("base_sha256"), sp.rendered(every).alias("spans"),
        sp.count(every, "live").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
    )
