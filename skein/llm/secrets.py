"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in the texts. The hash of each candidate's value is counted over the corpus: in how many
distinct repositories (documents, unless told otherwise) and at how many distinct owners (sources) it stands. A value
that few owners hold looks live; a widely copied one is an example. Texts are read once; what was found in them, without the text,
is written to the shared folder and joined with the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.durable import durable

#: kind, pattern, group that holds the value, least length of the value. In this order of kinds; the first three are the base.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("issued", r"(?:gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*", 0, 31),
)
BASE = ("assign", "access", "hex")
#: Live spans that are broadcast to their texts, at most.
BROADCAST_SPANS = 500_000
#: A copied value is left out before the join above so many documents, and above this part of all candidates.
BUSY, BUSY_SHARE = 1000, 100_000
#: Folds over a text's matches go by runs of so many, so that their cost doesn't grow with the square of the matches.
RUN = 64


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(array: Column, body) -> Column:
    """``body`` (run of elements) of each run of an array; an empty array has none."""
    last = F.floor((F.size(array) - 1) / RUN).cast("int")
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: body(F.slice(array, c * RUN + 1, RUN)))).otherwise(F.array())


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda acc, x: acc + x)


def _ahead(lengths: Column) -> Column:
    """Of each run of lengths, the sum of all before it."""
    sums = _runs(lengths, _total)
    return _bind(sums, lambda t: F.transform(t, lambda _, k: _total(F.slice(t, 1, k))))


def spans(text: Column, rank: int) -> Column:
    """array<struct<start, rank, end, kind, hash>> of a kind's matches, leftmost and not overlapping.

    What stands between matches (split) and the matches themselves give each match's place; counts are of code points.
    """
    kind, pattern, group, least = KINDS[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))

    def place(steps: Column, lengths: Column, ahead: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            run = F.floor(k / RUN).cast("int")
            start = F.element_at(ahead, run + 1) + _total(F.slice(lengths, run * RUN + 1, k % RUN)) + s["gap"]
            return F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["match"].alias("match"))

        return F.transform(steps, one)

    whole = F.filter(steps, lambda s: s["match"].isNotNull())
    placed = _bind(whole, lambda st: _bind(F.transform(st, lambda s: s["gap"] + s["size"]), lambda n: _bind(_ahead(n), lambda ahead: place(st, n, ahead))))
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    kept = F.filter(placed, lambda p: F.length(value(p["match"])) >= least)
    named = F.transform(kept, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(value(p["match"]).cast("binary"), 256).alias("hash")))
    return F.when(F.size(found) > 0, named).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"))


def _joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of (hash, owner, repo) rows. A hot hash is spread over its owners and repositories first."""
    of_owner = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return of_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan_secrets(docs: DataFrame, max_owners: int = 2, max_repos: int = 64, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """doc_id, text_key, base (array of spans), live (array of spans that few own), n_copied, one row per input row.

    A candidate is live if at most ``max_owners`` owners and ``max_repos`` repositories hold its value. text_key is
    xxhash64 of the text: rows with one id and one text have one result each, equal to each other's. A null text is
    empty; null ids, owners and repositories count as one id, owner, repository; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.xxhash64(text).alias("text_key"), *[spans(text, k).alias(kind) for k, (kind, *_) in enumerate(KINDS)])
    rows = durable(rows.select("doc_id", "owner", "repo", "text_key", F.array_sort(F.concat(*BASE)).alias("base"), F.array_sort(F.concat(*[k for k, *_ in KINDS])).alias("every")))
    found = rows.filter(F.size("every") > 0).select("doc_id", "text_key", "owner", "repo", F.explode("every").alias("s")).select("*", F.col("s.hash").alias("hash"))
    owners = durable(ownership(found).withColumn("is_live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)))
    total = rows.agg(F.coalesce(F.sum(F.size("every")), F.lit(0))).first()[0]
    busy = owners.filter(~F.col("is_live") & (F.col("n_repos") > max(BUSY, total // BUSY_SHARE))).select("hash")
    spread = found.join(F.broadcast(busy), "hash", "left_anti")  # BUSY_SHARE values at most
    judged = spread.select("doc_id", "text_key", "s", "hash").distinct().join(owners.filter("is_live").select("hash"), "hash", "left_semi")
    per_doc = judged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("s")).alias("live"))
    a, b = rows.select("doc_id", "text_key", "base", "every").alias("a"), per_doc.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")), "left")
    none = F.array().cast(rows.schema["base"].dataType)
    live = F.coalesce("live", none)
    return out.select("a.doc_id", "a.text_key", "base", live.alias("live"), (F.size("every") - F.size(live)).alias("n_copied"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and live ones), n_live, n_copied."""
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    every = F.array_sort(F.array_union("base", "live"))
    return scanned.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("n_copied").cast("long").alias("n_copied"))


def redact(docs: DataFrame, mark: str = "<secret>", max_owners: int = 2, max_repos: int = 64, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", chars_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, whole, with every live span replaced by ``mark`` (overlapping spans by one).

    Rows without live spans are unchanged, null texts too; columns of any name come along; ``chars_col``, if any, is set to the new length where a text changed.
    """
    scanned = scan_secrets(docs, max_owners, max_repos, id_col, text_col, owner_col, repo_col)
    live = durable(scanned.filter(F.size("live") > 0).select(F.col("doc_id").alias("live_id"), F.col("text_key").alias("live_text"), "live").dropDuplicates(["live_id", "live_text"]))
    live = F.broadcast(live) if live.agg(F.coalesce(F.sum(F.size("live")), F.lit(0))).first()[0] <= BROADCAST_SPANS else live
    # the input's columns go as one, so that none of their names meets ours
    text = F.col(f"`{text_col}`").cast("string")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("row_id"), text.alias("row_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_key"))
    rows = held.join(live, F.col("row_id").eqNullSafe(F.col("live_id")) & (F.col("row_key") == F.col("live_text")), "left")

    def masked(acc: Column, run: Column, part: Column) -> Column:
        """A run's piece of the text: live spans replaced, spans that begin in an earlier one only prolong it."""
        return F.aggregate(
            run,
            F.struct(acc["at"].alias("at"), F.lit("").alias("out")),
            lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(part, a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out")),
        )

    def step(acc: Column, run: Column) -> Column:
        part = F.substring(F.col("row_text"), acc["at"] + 1, F.array_max(F.transform(run, lambda s: s["end"])) - acc["at"])
        return _bind(part, lambda t: _bind(masked(acc, run, t), lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], done["out"]).alias("out"))))

    done = F.aggregate(_runs(F.col("live"), lambda run: run), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    new = _bind(done, lambda d: F.concat(d["out"], F.substring(F.col("row_text"), d["at"] + 1, F.length("row_text"))))
    out = rows.select("row", F.when(F.col("live").isNotNull(), new).alias("masked"))
    columns = []
    for c in docs.columns:
        was = F.col("row").getField(c)
        if c == text_col:
            columns.append(F.coalesce("masked", was).alias(c))
        elif c == chars_col:
            columns.append(F.when(F.col("masked").isNotNull(), F.length("masked").cast(docs.schema[c].dataType)).otherwise(was).alias(c))
        else:
            columns.append(was.alias(c))
    return out.select(*columns)
