"""Text retrieval and memory ranking over documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.durable import durable

#: Members held by far more owners than most that are broadcast at most; more are joined.
HOT = 200_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token, id, tf, size (tokens of the text)."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return t.select("id", F.size("t").alias("size"), F.explode("t").alias("token")).groupBy("token", "id", "size").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token, n_docs (distinct ids), n (occurrences), counted from ``postings`` for ids of several rows only.

    A text whose id is its own counts its distinct tokens where it is read, so that only counts of tokens are shuffled.
    """
    key = F.col(id_col)
    several = durable(docs.groupBy(key.alias("id_")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id_"))
    n = several.count()
    shared, single = None, docs
    if n:
        few = F.broadcast(several) if n <= HOT else several
        shared = docs.join(few, key.eqNullSafe(F.col("id_")), "left_semi")
        single = docs.join(few, key.eqNullSafe(F.col("id_")), "left_anti")
    t = single.select(tokens(F.col(text_col)).alias("t"))
    both = t.select(F.explode(F.array(F.struct(F.col("t").alias("w"), F.lit(0).alias("first")), F.struct(F.array_distinct("t").alias("w"), F.lit(1).alias("first")))).alias("x"))
    both = both.select("x.first", F.explode("x.w").alias("token"))
    out = both.groupBy("token").agg(F.sum("first").alias("n_docs"), F.sum(1 - F.col("first")).alias("n"))
    if shared is not None:
        more = postings(shared, id_col, text_col).groupBy("token", "id").agg(F.sum("tf").alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
        out = out.unionAll(more).groupBy("token").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    return out


def bm25(docs: DataFrame, query: str, top: int, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of the best texts for the distinct tokens of the query; empty without tokens.

    Only the query's tokens leave the scan: each text is reduced to its length and its counts of these tokens.
    """
    import re

    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).select("id", F.size("t").alias("size"), *[F.size(F.filter("t", _same(w))).alias(f"tf{k}") for k, w in enumerate(words)])
    t = durable(t)  # narrow rows, so the texts are read once
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(words))]).first()
    if not words or not stats.n:
        return t.select("id", F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    for k in range(len(words)):
        from math import log

        df = stats[f"df{k}"]
        idf = log((stats.n - df + 0.5) / (df + 0.5) + 1)
        tf = F.col(f"tf{k}")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / stats.mean))
    return t.select("id", F.round(score, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(top)


def _same(word: str):
    return lambda x: x == word


def line_scores(lines: DataFrame, phrase: str) -> DataFrame:
    """doc_id, score, line_no of each text's best line (the first of equals), and its confidence."""
    # fixed values: 50 and the phrase's bytes for a line with the phrase, 10 for each token in it; high from 60, medium from 20
    low, line = phrase.lower(), F.lower("line")
    score = F.when(line.contains(low), 50 + len(low.encode())).otherwise(0)
    for w in dict.fromkeys(low.split()):
        score = score + F.when(line.contains(w), 10).otherwise(0)
    s = lines.withColumn("score", score).filter("score > 0")
    best = s.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "line_no")).alias("b"))
    return best.select("doc_id", (-F.col("b.neg")).alias("score"), F.col("b.line_no").cast("long").alias("line_no"), F.when(F.col("b.neg") <= -60, "high").when(F.col("b.neg") <= -20, "medium").otherwise("low").alias("confidence"))


def chunks(docs: DataFrame, size: int = 6000, overlap: int = 400, with_text: bool = False) -> DataFrame:
    """doc_id, ordinal, begin, n_chars (and text) of windows of ``size`` characters that overlap; blank ones are left out."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(size - overlap)))).cast("int")
    d = docs.filter("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    begin = F.col("ordinal") * (size - overlap)
    part = F.trim(F.substring(F.col("text"), begin + 1, F.lit(size)))
    return d.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), begin.cast("long").alias("begin"), F.length(part).cast("long").alias("n_chars"), *([part.alias("text")] if with_text else [])).filter("n_chars > 0")


def token_estimate(text: Column) -> Column:
    """A quarter of the trimmed text's bytes, rounded up."""
    return F.ceil(F.octet_length(F.trim(text)) / 4).cast("long")


def rank_memory(events: DataFrame, query: str, now: int, half_life: float, top: int) -> DataFrame:
    """id, score: 0.6 times the part of the query's terms in the text, 0.4 times a recency that halves with each half life."""
    terms = list(dict.fromkeys(w for w in query.lower().split() if len(w) > 1))
    hits = sum((F.when(F.lower("text").contains(w), 1).otherwise(0) for w in terms), F.lit(0))
    lexical = hits / F.lit(float(max(len(terms), 1)))
    age = F.greatest(F.lit(0), F.lit(now) - F.col("observed_at"))
    recency = F.coalesce(F.pow(F.lit(0.5), age / F.lit(float(half_life))), F.lit(0.0))
    return events.select("id", F.round(0.6 * lexical + 0.4 * recency, 6).alias("score"), "observed_at").orderBy(F.desc("score"), F.desc("observed_at"), "id").limit(top).select("id", "score")


def innermost(points: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """Each point (file, at) with the shortest span (file, name, begin, end) over it, ties by name; a range join by buckets.

    Spans stand in every bucket that they touch, points in their one; the join is by file and bucket, not by file alone.
    """
    s = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.col("end") / bucket))))
    p = points.withColumn("b", F.floor(F.col("at") / bucket))
    j = p.join(s, ["file", "b"]).filter("at between begin and end")
    return j.groupBy("file", "at").agg(F.min(F.struct((F.col("end") - F.col("begin")).alias("size"), "name")).alias("m")).select("file", "at", F.col("m.name").alias("name"))


def overlap_pairs(sets: DataFrame, least: float) -> DataFrame:
    """a, b, jaccard of owners (owner, member) whose sets overlap by at least ``least``.

    Owners meet by the rarest members of each set only: two sets of this similarity share one of the first n - least * n + 1
    of both, in one order of all members, so a member that very many owners hold brings hardly any together. Only members held
    by over twice the mean are told apart by their number, the others go by a hash. Two exact bounds drop most of those that
    meet by chance: what can follow the shared member in both sets, and the bits of one set's members that the other lacks.
    What is left is compared whole.
    """
    given = sets.select("owner", "member").filter("owner is not null and member is not null")
    held = durable(given.groupBy("member").agg(F.count(F.lit(1)).alias("held")))
    rows, members = held.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count(F.lit(1))).first()
    hot = held.filter(F.col("held") > 2 * rows / max(members, 1))
    hot = F.broadcast(hot) if hot.count() <= HOT else hot
    placed = given.join(hot, "member", "left").select("owner", F.coalesce("held", F.lit(0)).alias("held"), "member").repartition("owner").distinct()
    whole = placed.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("held", F.xxhash64("member").alias("h"), "member"))).alias("m"))
    whole = durable(whole.select("owner", F.col("m.member").alias("members")))
    n = F.size("members")
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m), F.lit(64)).cast("int"))
    bits = F.aggregate("members", F.lit(0).cast("long"), lambda got, m: got.bitwiseOR(bit(m)))
    first = whole.select("owner", n.alias("n"), bits.alias("bits"), F.posexplode(F.slice("members", F.lit(1), (n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))).alias("place", "member"))
    x, y = first.alias("x"), first.alias("y")
    alike = (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least) - F.lit(1e-9)) & (F.col("x.owner") < F.col("y.owner"))
    lacks = lambda a, b: F.bit_count(F.col(f"{a}.bits").bitwiseAND(F.bitwise_not(f"{b}.bits")))
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"), F.col("x.n") - lacks("x", "y"), F.col("y.n") - lacks("y", "x"))
    enough = most >= (F.col("x.n") + F.col("y.n")) * F.lit(least / (1 + least)) - F.lit(1e-6)
    met = x.join(y, (F.col("x.member") == F.col("y.member")) & alike & enough).select(F.col("x.owner").alias("a"), F.col("y.owner").alias("b")).distinct()
    j = met.join(whole.select(F.col("owner").alias("a"), F.col("members").alias("ma")), "a").join(whole.select(F.col("owner").alias("b"), F.col("members").alias("mb")), "b")
    k = F.size(F.array_intersect("ma", "mb"))
    return j.select("a", "b", (k / (F.size("ma") + F.size("mb") - k)).alias("jaccard")).filter(F.col("jaccard") >= least)


def streaks(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """by, value, longest: the longest run of one value in order, per group (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(*order)
    v = Window.partitionBy(by, value).orderBy(*order)
    r = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    return r.groupBy(by, value, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(by, value).agg(F.max("n").alias("longest"))


def memory_candidates(events: DataFrame, query: str, limit: int) -> DataFrame:
    """id, score of the events to rank: the best by BM25, then the latest of the others (with a null score).

    From a limit of 8 a quarter is left for the latest. Only the query's first 16 distinct terms of two or more characters
    count; without terms all are the latest. ``events`` has id, text, observed_at; a null time is the oldest; ties go by id.
    """
    terms = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 1][:16]
    share = limit - (limit // 4 if limit >= 8 else 0)
    best = bm25(events, " ".join(terms), share, "id", "text")
    late = events.join(best.select("id"), "id", "left_anti").orderBy(F.desc_nulls_last("observed_at"), "id").limit(limit)
    both = best.select("id", "score", F.lit(0).alias("late"), F.lit(None).cast("long").alias("at")).unionAll(late.select("id", F.lit(None).cast("double"), F.lit(1), F.col("observed_at").cast("long")))
    return both.orderBy("late", F.desc("score"), F.desc_nulls_last("at"), "id").limit(limit).select("id", "score")


def retry_chunks(events: DataFrame, max_event: int, available: int) -> DataFrame:
    """id, chunk (from 1), n_chunks, tokens of events (id, text) of more than ``max_event`` or ``available`` tokens.

    A chunk has four bytes a token of the smaller bound; tokens are those of its bytes. Texts within both have no rows.
    """
    each = min(max_event, available)
    if each <= 0:
        raise ValueError("no tokens to fill")
    size = F.octet_length(F.trim("text"))
    n = F.ceil(size / F.lit(4 * each)).cast("int")
    big = events.filter(F.ceil(size / 4) > each).select("id", size.alias("size"), n.alias("n_chunks"), F.explode(F.sequence(F.lit(1), n)).alias("chunk"))
    return big.select("id", "chunk", "n_chunks", F.ceil(F.least(F.lit(4 * each), F.col("size") - 4 * each * (F.col("chunk") - 1)) / 4).cast("long").alias("tokens"))
