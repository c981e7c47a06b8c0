"""Statistics of judgements: agreement, ranks, slices, paired effects, what follows an event."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.operators.components import connected_components
from cairngraph.operators.skew import hot_keys, split_join
from cairngraph.workspace import Workspace


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    low = beta * beta * precision + recall
    return F.when(low == 0, 0.0).otherwise((1 + beta * beta) * precision * recall / low)


def score_slices(rows: DataFrame, by: str, beta: float = 2.0) -> DataFrame:
    """``by``, tp, fp, fn, precision, recall, f_beta from rows with tp, fp and fn; what has no case is 1."""
    s = rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = s.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0))
    s = s.withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0))
    return s.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa (null if neither varies), positive_agreement (null if neither says yes) of two yes-no columns."""
    x, y = F.col(a), F.col(b)
    count = lambda c: F.count(F.when(c, 1))
    s = rows.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), count(x == y).alias("same"), count(x).alias("xs"), count(y).alias("ys"), count(x & y).alias("both"), count(x | y).alias("either"))
    n = F.col("n")
    s = s.withColumn("observed", F.when(n > 0, F.col("same") / n)).withColumn("expected", F.when(n > 0, (F.col("xs") / n) * (F.col("ys") / n) + (1 - F.col("xs") / n) * (1 - F.col("ys") / n)))
    kappa = F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return s.select("n", F.col("observed").alias("agreement"), kappa.alias("kappa"), F.when(F.col("either") > 0, F.col("both") / F.col("either")).alias("positive_agreement"))


def tied_ranks(rows: DataFrame, column: str, name: str, work: Workspace) -> DataFrame:
    """Adds ``name``: the mean rank of equal values of ``column``.

    Values are counted, the counts put into ranges of values, and what is below a range carried on as one
    number a range: no task holds more values than a range has.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("_c"))
    cut = work.save(counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    carry = cut.groupBy("_part").agg(F.sum("_c").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    within = F.coalesce(F.sum("_c").over(Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = cut.withColumn("_in", within).join(F.broadcast(carry), "_part").select(column, (F.col("_from") + F.col("_in") + (F.col("_c") + 1) / 2).alias(name), "_c")
    # Values that many rows share are hot keys of the join.
    hot = hot_keys(ranks.select(column, F.col("_c").alias("n")), [column])
    return split_join(rows, ranks.drop("_c"), [column], "inner", hot)


def spearman(rows: DataFrame, x: str, y: str, work: Workspace | None = None) -> DataFrame:
    """One row: n, rho; null for fewer than three points or a constant column."""
    work = work or Workspace(rows.sparkSession, "ranks")
    ranked = tied_ranks(tied_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx", work), y, "_ry", work)
    s = ranked.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"))
    return s.select("n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("rho")).alias("rho"))


def paired_effect(rows: DataFrame, delta: str) -> DataFrame:
    """One row: n, mean, deviation (of a sample), error, passes (mean > 2 errors); nulls for fewer than two."""
    s = rows.where(F.col(delta).isNotNull()).agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("deviation"))
    error = F.col("deviation") / F.sqrt("n")
    return s.select("n", "mean", "deviation", F.when(F.col("n") > 1, error).alias("error"), F.when(F.col("n") > 1, F.col("mean") > 2 * error).alias("passes"))


def next_events(events: DataFrame, first: str) -> DataFrame:
    """next_type, n: what a user does right after an event of type ``first`` (null: nothing), by time, then id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    follows = events.withColumn("next_type", F.lead("event_type").over(order)).where(F.col("event_type") == first)
    return follows.groupBy("next_type").agg(F.count("*").alias("n"))


def max_matching(pairs: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """``by``, n_matched: the most one-to-one matches in each record's bipartite graph, by augmenting ways."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(group[left], group[right]):
            near.setdefault(a, []).append(b)
        taken: dict = {}

        def augment(a, seen: set) -> bool:
            for b in near[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in taken or augment(taken[b], seen):
                        taken[b] = a
                        return True
            return False

        return pd.DataFrame({by: [group[by].iloc[0]], "n_matched": [sum(augment(a, set()) for a in sorted(near))]})

    kind = dict(pairs.dtypes)[by]
    return pairs.select(by, left, right).distinct().groupBy(by).applyInPandas(run, f"{by} {kind}, n_matched int")


def greedy_matching(pairs: DataFrame, by: str, left: str, right: str, score: str) -> DataFrame:
    """``by``, left, right: matches taken in order of score, then names, each side once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lefts, rights, out = set(), set(), []
        for r in group.sort_values([score, left, right], ascending=[False, True, True]).to_dict("records"):
            if r[left] not in lefts and r[right] not in rights:
                lefts.add(r[left])
                rights.add(r[right])
                out.append({by: r[by], left: r[left], right: r[right]})
        return pd.DataFrame(out, columns=[by, left, right])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {left} {kinds[left]}, {right} {kinds[right]}")


def score_separation(rows: DataFrame, score: str, real: str) -> DataFrame:
    """One row, separation: the median score of the real findings less that of the rest; null if either are none."""
    of = lambda c: F.median(F.when(c, F.col(score)))
    return rows.where(F.col(score).isNotNull()).agg((of(F.col(real)) - of(~F.coalesce(F.col(real), F.lit(False)))).alias("separation"))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Of findings (file, line, category, confidence, ...) at one file, line and category the surest; ties by the other columns, least first. Null lines are one place."""
    key = ["file", "line", "category"]
    rest = [c for c in findings.columns if c not in (*key, "confidence")]
    best = findings.groupBy(*key).agg(F.min(F.struct((-F.col("confidence")).alias("_c"), *rest)).alias("r"))
    return best.select(*[F.col(c) if c in key else (-F.col("r._c")).alias(c) if c == "confidence" else F.col(f"r.{c}").alias(c) for c in findings.columns])


def match_findings(findings: DataFrame, truth: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """review, finding (null for a miss), truth, outcome (matched, ambiguous, noise, missed) of each finding and each unmet truth.

    ``findings``: review, finding, file, line, confidence, nth; ``truth``: review, truth, file, first, last, nth (null lines hold
    the whole file); ``ambiguous``: review, file. The surest finding comes first, then by nth, and takes the first
    truth that is left and accepts it. Findings and truths meet on review and file; a review is one task, as each choice bears on the next.
    """
    near = findings.select("review", "finding", "file", "line", "confidence", F.col("nth").alias("order"))
    goals = truth.select("review", "truth", F.col("file"), "first", "last", F.col("nth").alias("goal"))
    pairs = near.join(goals, ["review", "file"]).where("first is null or line between first and last").select("review", "finding", "confidence", "order", "truth", "goal")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken, out, met = set(), [], set()
        for r in group.sort_values(["confidence", "order", "goal"], ascending=[False, True, True]).itertuples(index=False):
            if r.finding not in met and r.truth not in taken:
                met.add(r.finding)
                taken.add(r.truth)
                out.append((r.review, r.finding, r.truth))
        return pd.DataFrame(out, columns=["review", "finding", "truth"])

    kinds = dict(pairs.dtypes)
    matched = pairs.groupBy("review").applyInPandas(run, f"review {kinds['review']}, finding {kinds['finding']}, truth {kinds['truth']}")
    rest = near.join(matched.select("review", "finding"), ["review", "finding"], "left_anti")
    doubt = ambiguous.select("review", "file").distinct().withColumn("doubt", F.lit(True)) if ambiguous is not None else rest.select("review", "file").where("false").withColumn("doubt", F.lit(True))
    loose = rest.join(doubt, ["review", "file"], "left").select("review", "finding", F.lit(None).cast(kinds["truth"]).alias("truth"), F.when(F.col("doubt"), "ambiguous").otherwise("noise").alias("outcome"))
    missed = goals.join(matched.select("review", "truth"), ["review", "truth"], "left_anti").select("review", F.lit(None).cast(kinds["finding"]).alias("finding"), "truth", F.lit("missed").alias("outcome"))
    return matched.withColumn("outcome", F.lit("matched")).unionByName(loose).unionByName(missed)


def review_scores(outcomes: DataFrame) -> DataFrame:
    """review, matched, noise, ambiguous, missed, recall, precision from ``match_findings``; ambiguous ones count against precision; what has no case is 1."""
    n = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    s = outcomes.groupBy("review").agg(n("matched"), n("noise"), n("ambiguous"), n("missed"))
    said = F.col("matched") + F.col("noise") + F.col("ambiguous")
    real = F.col("matched") + F.col("missed")
    return s.withColumn("recall", F.when(real > 0, F.col("matched") / real).otherwise(1.0)).withColumn("precision", F.when(said > 0, F.col("matched") / said).otherwise(1.0))


def union_of_runs(runs: DataFrame, beta: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(url, n_goldens, n_candidates, tp, fp, fn, delta; one row: n, mean, deviation, error, passes, f_beta of the union, mean_f_beta of the runs).

    ``runs``: run, url, golden, candidate, hit, of all pairs; with n_goldens and n_candidates, repeated on each row, so that a run without pairs has a row with null golden. Only urls of all
    runs count, and all must agree on n_goldens. The candidates of the runs are put side by side and matched one to one anew. ``delta`` is the union's true positives less the runs' mean.
    """
    all_runs = runs.select("run").distinct().count()
    if all_runs < 2:
        raise ValueError("a union needs two runs")
    sizes = runs.groupBy("url", "run").agg(F.max("n_goldens").alias("g"), F.max("n_candidates").alias("c"))
    shared = sizes.groupBy("url").agg(F.count("*").alias("r"), F.min("g").alias("g"), F.max("g").alias("most"), F.sum("c").alias("c")).where(F.col("r") == all_runs)
    if shared.where("g <> most").take(1):
        raise ValueError("runs disagree about the goldens of a url")
    hits = runs.where("hit = 1").join(shared.select("url"), "url", "left_semi")
    whole = max_matching(hits.select("url", F.col("golden").alias("l"), F.concat_ws("/", "run", "candidate").alias("r")), "url", "l", "r")
    each = max_matching(hits.select(F.concat_ws("\x1f", "url", "run").alias("place"), F.col("golden").alias("l"), F.col("candidate").alias("r")), "place", "l", "r")
    each = sizes.join(shared.select("url"), "url", "left_semi").withColumn("place", F.concat_ws("\x1f", "url", "run")).join(each, "place", "left").na.fill(0, ["n_matched"])
    mean = each.groupBy("url").agg(F.avg("n_matched").alias("mean_tp"))
    rows = shared.join(whole, "url", "left").na.fill(0, ["n_matched"]).join(mean, "url")
    rows = rows.select("url", F.col("g").alias("n_goldens"), F.col("c").alias("n_candidates"), F.col("n_matched").alias("tp"), (F.col("c") - F.col("n_matched")).alias("fp"), (F.col("g") - F.col("n_matched")).alias("fn"), (F.col("n_matched") - F.col("mean_tp")).alias("delta"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    per_run = each.groupBy("run").agg(F.sum("n_matched").alias("t"), F.sum("c").alias("c"), F.sum("g").alias("g")).select(ratio(F.col("t"), F.col("c")).alias("p"), ratio(F.col("t"), F.col("g")).alias("r"))
    means = per_run.agg(F.avg("p").alias("p"), F.avg("r").alias("r")).select(f_beta(F.col("p"), F.col("r"), beta).alias("mean_f_beta"))
    total = rows.agg(F.sum("tp").alias("t"), F.sum("n_candidates").alias("c"), F.sum("n_goldens").alias("g")).select(f_beta(ratio(F.col("t"), F.col("c")), ratio(F.col("t"), F.col("g")), beta).alias("f_beta"))
    return rows, paired_effect(rows, "delta").join(total).join(means)


# How a changed test file is named, and what a symbol or path may be written with.
TEST_NAME = r"^tests/(?:.+/)?test_([^/]+)\.py$"


def change_chunks(files: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """chunk (its least file), file: changed files joined by links between them, and tests with the one file they are named after.

    ``files``: file; ``links``: source_file, target_file, of imports and calls. A test file test_X joins the one changed file whose path,
    its slashes as underscores, is X or ends with _X at an underscore; of several none.
    """
    files = work.save(files.select("file").where("file is not null").distinct())
    own = lambda c: files.select(F.col("file").alias(c))
    near = links.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).where("a <> b").join(own("a"), "a", "left_semi").join(own("b"), "b", "left_semi")
    tests = files.select(F.col("file").alias("a"), F.regexp_extract("file", TEST_NAME, 1).alias("name")).where("name <> ''")
    flat = files.where(F.col("file").endswith(".py") & (F.regexp_extract("file", TEST_NAME, 1) == "")).select(F.col("file").alias("b"), F.split(F.translate(F.regexp_replace("file", r"\.py$", ""), "/", "_"), "_").alias("parts"))
    tails = flat.select("b", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), "_"))).alias("name"))
    named = tests.join(tails, "name").distinct().groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("a", "b")
    every = near.unionByName(named).unionByName(files.select(F.col("file").alias("a"), F.col("file").alias("b")))
    return connected_components(every, work).select(F.col("component").alias("chunk"), F.col("id").alias("file"))


def normal_symbol(c: Column) -> Column:
    """The ways a symbol is written, as dots: paths, ::, call parentheses, back ticks, receivers of methods."""
    s = F.btrim(F.btrim(F.btrim(c), F.lit("`")))
    s = F.regexp_replace(s, r"^func \(\w*\s*\*?(\w+)\)\s*(\w+).*$", "$1.$2")
    s = F.regexp_replace(s, r"\(\*?(\w+)\)", "$1")
    s = F.when(F.contains(s, F.lit("/")), F.regexp_replace(s, r"\.go(?=$|[.:])", "")).otherwise(s)
    s = F.regexp_replace(s, r"\([^()]*\)$", "")
    s = F.regexp_replace(s, r"::|:|/|\\", ".")
    return F.btrim(F.regexp_replace(s, r"\.(?:py|tsx|ts|jsx|js)\.", "."), F.lit("."))


def normal_file(c: Column) -> Column:
    s = F.regexp_replace(F.translate(F.btrim(F.btrim(F.btrim(c), F.lit("`"))), "\\", "/"), r":\d+(?:[-:]\d+)?$", "")
    return F.regexp_replace(s, r"^(?:\./)*/*", "")


def answer_scores(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """task, n_gold, n_found, recall, n_said, n_unexpected, precision of answers against keys.

    ``gold``: task, kind (symbol, file), id, spelling, required; several spellings of one id are any of them, ones that are not required
    may be named without harm. ``answers``: task, kind, said. A symbol is named where the key's parts stand whole within what is said; a file where
    one path is the other or its tail, and that tail has a directory. Each task's few names meet only its own.
    """
    norm = lambda c: F.when(F.col("kind") == "symbol", normal_symbol(F.col(c))).otherwise(normal_file(F.col(c)))
    keys = gold.select("task", "kind", "id", "required", norm("spelling").alias("g")).where("g <> ''").distinct()
    said = answers.select("task", "kind", norm("said").alias("p")).distinct()
    inside = F.contains(F.concat(F.lit("."), "p", F.lit(".")), F.concat(F.lit("."), "g", F.lit(".")))
    tail = lambda a, b: F.contains(F.col(b), F.lit("/")) & F.col(a).endswith(F.concat(F.lit("/"), b))
    fits = F.when(F.col("kind") == "symbol", inside).otherwise((F.col("p") == F.col("g")) | tail("p", "g") | tail("g", "p"))
    hits = said.join(keys, ["task", "kind"]).where(fits)
    n = keys.where("required").groupBy("task").agg(F.countDistinct("kind", "id").alias("n_gold"))
    found = hits.where("required").groupBy("task").agg(F.countDistinct("kind", "id").alias("n_found"))
    total = said.groupBy("task").agg(F.count("*").alias("n_said"))
    odd = said.join(hits.select("task", "kind", "p").distinct(), ["task", "kind", "p"], "left_anti").groupBy("task").agg(F.count("*").alias("n_unexpected"))
    tasks = gold.select("task").unionByName(answers.select("task")).distinct()
    rows = tasks.join(n, "task", "left").join(found, "task", "left").join(total, "task", "left").join(odd, "task", "left").na.fill(0)
    return rows.select("task", "n_gold", "n_found", F.when(F.col("n_gold") > 0, F.col("n_found") / F.col("n_gold")).otherwise(1.0).alias("recall"), "n_said", "n_unexpected", F.when(F.col("n_said") > 0, (F.col("n_said") - F.col("n_unexpected")) / F.col("n_said")).otherwise(0.0).alias("precision"))


REVIEW = "pr int, at timestamp, model string, n_findings int, seconds double, rating int"


def record_review(reviews: DataFrame, folder: str) -> None:
    """Append reviews (REVIEW) to the log, one JSON object a line."""
    reviews.select([c.split()[0] for c in REVIEW.split(", ")]).write.mode("append").json(folder)


def load_reviews(spark, folder: str) -> DataFrame:
    """The log; lines that are no JSON are left out."""
    rows = spark.read.schema(REVIEW + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.where("at is not null").drop("_corrupt")
