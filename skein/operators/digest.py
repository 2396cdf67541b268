"""Digests of logs and metrics, and gates over histories of runs. All are partial aggregations or windows over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(line: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


_OPEN, _CLOSE = r"""^[(\[{"']+""", r"""[)\]}"',;:]+$"""
#: What a word's core may be, in this order; the rest of the word is kept.
_CORES = [
    ("<path>", r"[/\\]|[^./\\]\.(rs|py|ts|tsx|js|jsx|kt|zig|gd|java|md)$"),
    ("<ver>", r"^(v[0-9]+(\.[0-9]+)+|[0-9]+(\.[0-9]+){2,})$"),
    ("<hash>", r"^[0-9A-Fa-f]{0,39}[A-Fa-f][0-9A-Fa-f]{0,39}$"),
    ("<n>", r"^[+-]*[0-9,]*\.?[0-9,]*[A-Za-z]*%?$"),
]


#: What every variable word has; others are left as they are without a further look.
_VARIABLE = r"[0-9/\\]|\.[a-z]|[A-Fa-f]{7}"


def _filled(word: Column) -> Column:
    """The word with its core, inside brackets, quotes and final punctuation, as a placeholder if the core is variable."""
    core = F.regexp_replace(F.regexp_replace(word, _OPEN, ""), _CLOSE, "")
    kind = F.when(core == "", F.lit(None).cast("string"))
    for name, pattern in _CORES:
        fits = core.rlike(pattern)
        if name == "<hash>":
            fits = fits & F.length(core).between(7, 40)
        if name == "<n>":
            fits = fits & core.rlike("^[^A-Za-z]*[0-9]")
        kind = kind.when(fits, name)
    return F.when(kind.isNull(), word).otherwise(F.concat(F.regexp_extract(word, _OPEN, 0), kind, F.regexp_extract(word, _CLOSE, 0)))


def template(line: Column) -> Column:
    """The line with paths, versions, hashes and numbers as placeholders, word by word, so that repeats of one message are equal.

    ``[digits]`` is a time stamp; of ``key=value`` the key is kept; of ``Verb name v1.2`` the name is a placeholder as well.
    """
    def one(word: Column) -> Column:
        key = F.regexp_extract(word, "^[A-Za-z0-9_.-]+=", 0)
        value = F.substring(word, F.length(key) + 1, F.length(word))
        return F.when(~word.rlike(_VARIABLE), word).when(word.rlike(r"^\[[0-9]+\]$"), "[<ts>]").when((key == "") | (value == ""), _filled(word)).otherwise(F.concat(key, _filled(value)))

    out = F.array_join(F.transform(F.split(normalize(line), " "), one), " ")
    return F.regexp_replace(out, r"^([A-Z][A-Za-z]*) [A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]* <ver>( |$)", "$1 <name> <ver>$2")


def signal(line: Column) -> Column:
    """error before warning; other lines are plain."""
    low = F.lower(F.trim(line))
    error = r"^(traceback|panic:|error |error\[|failed |fatal:|caused by:|e   )| panicked at |exception|error:|test result: failed|segmentation fault|core dumped"
    return F.when(low.rlike(error), "error").when(low.rlike("^(warning:|warn:)| warning[ :]"), "warning").otherwise("plain")


def anchor(line: Column) -> Column:
    """path, line, column of the first place in a source that the line names: ``File "x", line n``, or a word path:line[:column].

    Null fields if it names none.
    """
    told = r'File "([^"]+)", line ([0-9]+)'
    word = r"""(?:^|[\s(\["',])([^\s:()\["',]*(?:[/\\][^\s:()\["',]+|\.(?:rs|py|ts|tsx|js|jsx|kt|zig|gd|java|md))):([0-9]+)(?::([0-9]+))?"""
    by_file, n = line.rlike(told), lambda c: F.expr("null") if c is None else F.nullif(c, F.lit("")).cast("long")
    path = F.when(by_file, F.regexp_extract(line, told, 1)).otherwise(F.regexp_extract(line, word, 1))
    at = F.when(by_file, F.regexp_extract(line, told, 2)).otherwise(F.regexp_extract(line, word, 2))
    column = F.when(~by_file, F.regexp_extract(line, word, 3))
    return F.struct(F.nullif(path, F.lit("")).alias("path"), n(at).alias("line"), n(column).alias("column"))


def repeated_lines(lines: DataFrame, top: int) -> DataFrame:
    """line, occurrences, families of the lines that repeat, most first."""
    n = lines.select(normalize(F.col("line")).alias("line")).filter("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    return n.filter("occurrences > 1").orderBy(F.desc("occurrences"), "line").limit(top)


def families(lines: DataFrame, top: int) -> DataFrame:
    """template, occurrences, distinct_lines, signal of each family of lines."""
    l = lines.select(normalize(F.col("line")).alias("line")).filter("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    f = l.groupBy(template(F.col("line")).alias("template")).agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_lines"))
    return f.orderBy(F.desc("occurrences"), "template").limit(top).withColumn("signal", signal(F.col("template")))


def metric_deltas(runs: DataFrame, near: float = 1e-9) -> DataFrame:
    """metric, previous, current, delta, percent, trend between the last run and the one before (run_no, metric, value)."""
    w = Window.partitionBy("metric").orderBy(F.desc("run_no"))
    r = runs.withColumn("place", F.row_number().over(w)).withColumn("previous", F.lead("value").over(w)).filter("place = 1 and previous is not null")
    d = r.withColumn("delta", F.col("value") - F.col("previous"))
    percent = F.when(F.abs("previous") > near, F.round(F.col("delta") / F.col("previous") * 100, 6))
    trend = F.when(F.abs("delta") <= near, "flat").when(F.col("delta") > 0, "up").otherwise("down")
    return d.select("metric", F.round("previous", 6).alias("previous"), F.round("value", 6).alias("current"), F.round("delta", 6).alias("delta"), percent.alias("percent"), trend.alias("trend"))


def medians(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Exact median (the mean of the middle two) and the number of samples."""
    return samples.groupBy(*by).agg(F.round(F.expr(f"percentile({value}, 0.5)"), 6).alias("median"), F.count(F.lit(1)).alias("samples"))


def promotion_gate(samples: DataFrame, baseline: str, threshold: float, least: int = 3) -> DataFrame:
    """candidate, workload, base_median, median, verdict (beats, blocked, insufficient) of (workload, backend, value) samples."""
    m = medians(samples, ["workload", "backend"])
    base = m.filter(F.col("backend") == baseline).select("workload", F.col("median").alias("base_median"), F.col("samples").alias("base_samples"))
    c = m.filter(F.col("backend") != baseline).join(base, "workload")
    few = (F.col("samples") < least) | (F.col("base_samples") < least)
    verdict = F.when(few, "insufficient").when(F.col("median") <= F.col("base_median") * (1 - threshold), "beats").otherwise("blocked")
    return c.select(F.col("backend").alias("candidate"), "workload", "base_median", "median", verdict.alias("verdict"))


def collect_garbage(artifacts: DataFrame, roots: DataFrame, now: int, grace: int) -> DataFrame:
    """key, action: rooted or young artifacts (key, at) are retained, others swept; roots (key) without artifact need repair."""
    r = roots.select("key").distinct().withColumn("rooted", F.lit(True))
    j = artifacts.join(r, "key", "full")
    action = F.when(F.col("at").isNull(), "repair").when(F.col("rooted") | (F.lit(now) - F.col("at") < grace), "retain").otherwise("sweep")
    return j.select("key", action.alias("action"))


def overlay(base: DataFrame, writes: DataFrame) -> DataFrame:
    """key, value of a base (key, value) under an overlay (key, value, gone): a tombstone hides, a write replaces, else the base."""
    j = base.select("key", F.col("value").alias("old")).join(writes.select("key", F.col("value").alias("new"), F.col("gone"), F.lit(True).alias("written")), "key", "full")
    return j.filter(~F.coalesce("gone", F.lit(False))).select("key", F.when(F.col("written"), F.col("new")).otherwise(F.col("old")).alias("value"))


def stack_groups(lines: DataFrame, frame: Column, least: int = 2) -> DataFrame:
    """doc_id, first_line, n_frames of runs of consecutive lines that are frames; any other line closes a group.

    Windows are by document, over its frames only.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    runs = lines.filter(frame).withColumn("run", F.col("line_no") - place).groupBy("doc_id", "run")
    return runs.agg(F.min("line_no").cast("long").alias("first_line"), F.count(F.lit(1)).alias("n_frames")).filter(F.col("n_frames") >= least).drop("run")


def session_costs(turns: DataFrame) -> DataFrame:
    """session_id, input_tokens, output_tokens, total_tokens, largest_turn, input_share of (session_id, turn, role, tokens).

    Null tokens count as 0; of equal turns the first is the largest; the share is a percentage to 2 places, null without tokens.
    """
    t = F.coalesce("tokens", F.lit(0))
    own = lambda role: F.sum(F.when(F.col("role") == role, t).otherwise(0))
    g = turns.groupBy("session_id").agg(own("user").alias("input_tokens"), own("assistant").alias("output_tokens"), F.sum(t).alias("total_tokens"), F.min(F.struct((-t).alias("neg"), "turn")).alias("top"))
    share = F.when(F.col("total_tokens") > 0, F.round(100.0 * F.col("input_tokens") / F.col("total_tokens"), 2))
    return g.select("session_id", "input_tokens", "output_tokens", "total_tokens", F.col("top.turn").alias("largest_turn"), share.alias("input_share"))


def regressions(runs: DataFrame, drop: float = 5.0) -> DataFrame:
    """metric, run_no, previous, value of runs whose value fell by ``drop`` or more since the metric's run before."""
    w = Window.partitionBy("metric").orderBy("run_no")
    r = runs.withColumn("previous", F.lag("value").over(w)).filter(F.col("previous") - F.col("value") >= drop)
    return r.select("metric", "run_no", F.round("previous", 6).alias("previous"), F.round("value", 6).alias("value"))


def failures(lines: DataFrame) -> DataFrame:
    """path, line, column, message, tests, occurrences of the failures in test output (doc_id, line_no, line).

    A block begins with ``---- name stdout ----`` or ``____ name ____`` and ends at the next one, ``failures:``,
    ``test result:``, ``short test summary info`` or a line of ``====``. Its message is the first line of signal error, else
    the first with text; its place is that of the first line that names one. Equal failures are one row.
    """
    header = F.coalesce(F.nullif(F.regexp_extract("line", r"^---- (.+) stdout ----$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^_{3,} (\S.*?) _{3,}$", 1), F.lit("")))
    ends = F.col("line").rlike("^(failures:$|test result:|=*.?short test summary info|====)")
    own = Window.partitionBy("doc_id").orderBy("line_no")  # one output's lines, in order
    marked = lines.withColumn("test", header).withColumn("mark", F.when(F.col("test").isNotNull(), F.col("line_no")).when(ends, -1))
    inside = marked.withColumn("block", F.last("mark", True).over(own)).filter("block >= 0")
    text, place = F.trim(F.col("line")), anchor(F.col("line"))
    body = inside.withColumn("text", F.when(F.col("test").isNull() & (text != ""), text)).withColumn("place", F.when(F.col("test").isNull(), place))
    first = body.groupBy("doc_id", "block").agg(
        F.max("test").alias("test"),
        F.coalesce(F.min_by("text", F.when(signal(F.col("text")) == "error", F.col("line_no"))), F.min_by("text", F.when(F.col("text").isNotNull(), F.col("line_no")))).alias("message"),
        F.min_by("place", F.when(F.col("place.path").isNotNull(), F.col("line_no"))).alias("place"),
    )
    out = first.groupBy("place.path", "place.line", "place.column", "message")
    return out.agg(F.array_sort(F.collect_set("test")).alias("tests"), F.count(F.lit(1)).alias("occurrences"))


def metric_direction(metric: Column) -> Column:
    """lower or higher (is better) by parts of the metric's name, lower first; else unknown."""
    # fixed values
    lower = "mae|mse|rmse|loss|latency|duration|time|cost|token|error|stderr|stddev|variance|p95|p99|failure"
    higher = "score|accuracy|pass|throughput|qps|ops|success|precision|recall|f1|coverage|stability|wins"
    low = F.lower(metric)
    return F.when(low.rlike(lower), "lower").when(low.rlike(higher), "higher").otherwise("unknown")


def cache_regressions(samples: DataFrame, drop: float = 5.0) -> DataFrame:
    """session_id, run_no, kind: what got worse since the session's run before (session_id, run_no, ratio, net, regressions).

    The cached ratio fell by ``drop`` points or more; the net cached tokens went below 0 or under half of a positive number;
    the count of regressions rose. Nulls compare with nothing.
    """
    w = Window.partitionBy("session_id").orderBy("run_no")
    r = samples.select("*", *[F.lag(c).over(w).alias(f"was_{c}") for c in ("ratio", "net", "regressions")])
    fell = ((F.col("was_net") >= 0) & (F.col("net") < 0)) | ((F.col("was_net") > 0) & (F.col("net") * 2 < F.col("was_net")))
    kinds = F.array_compact(F.array(
        F.when(F.col("was_ratio") - F.col("ratio") >= drop, "ratio_drop"),
        F.when(fell, "net_drop"),
        F.when(F.col("regressions") > F.col("was_regressions"), "regressions_rise"),
    ))
    return r.select("session_id", "run_no", F.explode(kinds).alias("kind"))


def strategy_ranks(runs: DataFrame) -> DataFrame:
    """strategy, place and means of retrieval runs (strategy, found, useful_hits, output_tokens, estimated_tokens, tool_calls, latency_ms).

    Places go by the rate of runs that found their target, useful hits, the rate of runs without output, estimated tokens,
    output tokens, tool calls, latency and name. Nulls aren't counted in means.
    """
    g = runs.groupBy("strategy").agg(
        F.avg(F.col("found").cast("int")).alias("found_rate"),
        F.avg("useful_hits").alias("useful_hits"),
        F.avg((F.col("output_tokens") == 0).cast("int")).alias("empty_rate"),
        *[F.avg(c).alias(c) for c in ("estimated_tokens", "output_tokens", "tool_calls", "latency_ms")],
    )
    order = [F.desc("found_rate"), F.desc("useful_hits"), "empty_rate", "estimated_tokens", "output_tokens", "tool_calls", "latency_ms", "strategy"]
    return g.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row a strategy


def hop_cap_gate(samples: DataFrame, base: int = 64, candidates: tuple = (128, 256, 512), allowed: float = 10.0, least: int = 3) -> DataFrame:
    """cap, verdict (promote, blocked, insufficient) of (cap, workload, ms, rows): every workload's median time may grow by
    ``allowed`` percent over the base cap's at most, and its median rows must not fall. Every workload of the base must be there."""
    m = samples.groupBy("cap", "workload").agg(F.expr("percentile(ms, 0.5)").alias("ms"), F.expr("percentile(rows, 0.5)").alias("rows"), F.count(F.lit(1)).alias("n"))
    b = m.filter(F.col("cap") == base).select("workload", F.col("ms").alias("base_ms"), F.col("rows").alias("base_rows"), F.col("n").alias("base_n"))
    caps = samples.select("cap").filter(F.col("cap").isin(*candidates)).distinct()
    pairs = caps.select("cap", F.explode(F.array(F.lit(1))).alias("one")).join(b.withColumn("one", F.lit(1)), "one").join(m, ["cap", "workload"], "left")
    few = F.max(((F.coalesce("n", F.lit(0)) < least) | (F.col("base_n") < least)).cast("int")) == 1
    bad = F.max(((F.col("ms") > F.col("base_ms") * (1 + allowed / 100)) | (F.col("rows") < F.col("base_rows"))).cast("int")) == 1
    return pairs.groupBy("cap").agg(F.when(few, "insufficient").when(bad, "blocked").otherwise("promote").alias("verdict"))
