"""Documents drawn from several sources so that each makes up its share of the tokens.

A classifier, fitted on documents that name their source, says how likely each source is by a document's
text; where the document names one itself, that is weighed in as evidence that may be wrong. So every
document is a soft member of all sources. A document's rate, how often it is used, lies between 0
and its cap. Projected gradient steps on the squares of what each source's expected tokens lack give
the rates. The projection is lazy: steps are summed up, one number for each source, and rates are
the summed steps cut at 0 and the cap, so that a pass over the documents needs nothing of the passes before it
and sends back one sum and one row of curvature for each source. Rates are rounded so that their tokens are
kept, and a bounded pool of documents makes up what the rounding left owing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.functions.text import lower_word
from cairngraph.llm.tokens import TOKENIZER, count_tokens
from cairngraph.workspace import Workspace

#: Labelled documents of one source that the classifier is fitted on and held against, at most.
TRAIN_PER_SOURCE = 400
#: Share of them that are held out of the fitting, to temper and to report.
HELD_OUT = 0.25
FEATURES = 2048
LAYOUT = 512
#: How often the source a document names is taken to be its own. 1 makes members of one source only; None leaves the name out.
TRUST = 0.99
TOLERANCE = 1e-4
#: A pass that takes less than this share off the best misfit counts as idle; three in a row end the search.
IDLE, IDLE_PASSES = 0.01, 3
#: A source less likely than this does not lower a document's cap.
PLAUSIBLE = 0.1
#: Documents in one group of the rounding, about; it bounds what one task sorts.
ROUNDING_GROUP = 20_000
#: Documents of one source and size class (powers of two) in the pool that settles what is owed, at most.
POOL = 64

_WORD = re.compile(r"\w+|[^\w\s]")
_SHAPE = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_places: dict[str, int] = {}


def source_name(c: Column | str) -> Column:
    """A source as mix_targets spells it: small, without white space around, hyphens and spaces as underscores."""
    return F.regexp_replace(lower_word(c), r"[\s-]+", "_")


def _place(word: str, low: int, high: int) -> int:
    """The feature of a word; those met before are remembered, up to a bound."""
    at = _places.get(word)
    if at is None:
        at = low + zlib.crc32(word.encode()) % (high - low)
        if len(_places) < 300_000:
            _places[word] = at
    return at


def marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features of a whole text, of length 1: hashed words and marks, how its lines begin and how many there are."""
    split = FEATURES - LAYOUT
    lines = text.splitlines() or [""]
    counts: dict[int, float] = {}
    for w, n in Counter(_WORD.findall(text.lower())).items():
        at = _places.get(w)
        at = _place(w, 0, split) if at is None else at
        counts[at] = counts.get(at, 0.0) + n
    starts = Counter(x[:12] for x in lines)
    shape = [("size", int(2 * math.log2(len(text) + 1))), ("lines", min(20, len(lines))), ("first", lines[0][:2]), ("last", text[-1:])]
    for w, n in [*(("\n" + _DIGITS.sub("0", _SHAPE.sub("w", x)), n) for x, n in starts.items()), *((f"\n{k}{x}", 1) for k, x in shape)]:
        at = _place(w, split, FEATURES)
        counts[at] = counts.get(at, 0.0) + n
    v = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return np.fromiter(counts, np.int64, len(counts)), v / (math.sqrt(float(v @ v)) or 1.0)


def features(text: str) -> np.ndarray:
    v = np.zeros(FEATURES, dtype=np.float32)
    at, values = marks(text)
    v[at] = values
    return v


@dataclass(frozen=True)
class Classifier:
    """``held_out``: for each source how many documents were held out and how many of them it told."""

    names: tuple[str, ...]
    weights: np.ndarray
    shift: np.ndarray
    prior: np.ndarray
    warmth: float = 1.0
    held_out: dict[str, tuple[int, int]] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + self.shift) / self.warmth

    def posteriors(self, texts: list[str]) -> np.ndarray:
        z = np.zeros((len(texts), len(self.names)), np.float32)
        for i, t in enumerate(texts):  # a text has few of the features
            at, values = marks(t)
            z[i] = values @ self.weights[at]
        return _softmax((z + self.shift) / self.warmth) if texts else z

    def memberships(self, texts: list[str], labels: np.ndarray, trust: float | None) -> np.ndarray:
        """Posteriors given the text and, unless ``trust`` is None, the source that is named (its number, -1 for none)."""
        p = self.posteriors(texts).astype(np.float64)
        named = np.flatnonzero(labels >= 0)
        if trust is None or not len(named):
            return p
        # Who names another source than its own names each by how common it is.
        share = self.prior / max(self.prior.sum(), 1e-12)
        said = labels[named]
        wrong = (1 - trust) * share[said][:, None] / np.maximum(1 - share[None, :], 1e-12)
        wrong[np.arange(len(named)), said] = trust
        q = p[named] * wrong
        q[np.arange(len(named)), said] = np.maximum(q[np.arange(len(named)), said], 1e-12)
        p[named] = q / q.sum(axis=1, keepdims=True)
        return p


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _warmth(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes held-out labels most likely."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    return float(min(np.geomspace(0.25, 4, 33), key=loss))


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], prior: np.ndarray, rounds: int = 120, rate: float = 12.0, decay: float = 1e-5) -> Classifier:
    """Softmax regression by gradient descent with momentum; sources weigh alike while fitting, then by ``prior``."""
    k = len(names)
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    goal = np.eye(k, dtype=np.float32)[y]
    share = np.bincount(y, minlength=k).astype(np.float32)
    each = (1 / np.maximum(share, 1))[y][:, None] / max(1, (share > 0).sum())
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - goal) * each
        mw = 0.9 * mw + x.T @ g + decay * w
        mb = 0.9 * mb + g.sum(axis=0)
        w -= rate * 0.1 * mw
        b -= rate * 0.1 * mb
    with np.errstate(divide="ignore"):
        lean = np.log(np.maximum(prior, 1e-12) * max(1, (share > 0).sum()))
    return Classifier(names, w, np.where(share > 0, b + lean, -1e9).astype(np.float32), np.asarray(prior, dtype=np.float64))


def train(labelled: DataFrame, names: list[str], per_source: int = TRAIN_PER_SOURCE) -> Classifier:
    """A classifier from doc_id, text and label (number of the source), of each source the ``per_source`` with the least hash; every fourth of them is held out.

    Priors are the labels' shares of all labelled rows.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().toLocalIterator()}
    total = sum(counts.values())
    prior = np.array([counts.get(i, 0) / max(1, total) for i in range(len(names))], dtype=np.float64)
    # A threshold on the hash keeps about the wanted number of each source, before any sort.
    keep = F.create_map(*[x for i in range(len(names)) for x in (F.lit(i), F.lit(min(1.0, 1.5 * per_source / max(1, counts.get(i, 0)) + 1e-9)))])
    hashed = labelled.withColumn("h", F.xxhash64("doc_id")).where((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) <= keep[F.col("label")])
    picked = hashed.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).where(F.col("nth") <= per_source)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "nth": b["nth"], "x": [features(t).astype(np.float16).tobytes() for t in b["text"]]})

    rows = picked.select("label", "nth", "text").mapInPandas(run, "label int, nth int, x binary").collect()
    if not rows:
        return Classifier(tuple(names), np.zeros((FEATURES, len(names)), np.float32), np.zeros(len(names), np.float32), np.ones(len(names)))
    rows.sort(key=lambda r: (r["label"], r["nth"]))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16).astype(np.float32) for r in rows])
    y = np.array([r["label"] for r in rows])
    apart = np.array([r["nth"] % round(1 / HELD_OUT) == 0 for r in rows])
    model = fit(x[~apart], y[~apart], tuple(names), prior)
    z = model.logits(x[apart])
    told = z.argmax(axis=1) == y[apart]
    held = {n: (int((y[apart] == i).sum()), int(told[y[apart] == i].sum())) for i, n in enumerate(names)}
    # Held-out documents are as many of each source; they count by how common it is.
    weight = np.array([prior[i] / max(1, held[names[i]][0]) for i in y[apart]])
    pick = np.random.default_rng(0).choice(len(weight), 4000, p=weight / weight.sum()) if weight.sum() > 0 else np.zeros(0, int)
    return Classifier(model.names, model.weights, model.shift, model.prior, _warmth(z[pick], y[apart][pick]), held)


def labelled(documents: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, text, label (number of the source it names, null if it names none of ``names``)."""
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text", number[source_name("source")].alias("label"))


def memberships(docs: DataFrame, model: Classifier, path: str = TOKENIZER, trust: float | None = TRUST) -> DataFrame:
    """doc_id, n_tokens, label, p (likelihood of each source) of every document of ``labelled``."""

    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            p = model.memberships(texts, b["label"].fillna(-1).to_numpy(int), trust)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": count_tokens(texts, path), "label": b["label"].astype("Int32"), "p": list(p)})

    return docs.mapInPandas(run, "doc_id long, n_tokens long, label int, p array<double>")


def _rates(p: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.clip(p @ steps, 0, cap)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """A column of lists of k numbers as rows of a matrix, without an object for each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _pass(table: DataFrame, k: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each source at the rates that ``steps`` give, and how they change with the steps."""

    def run(batches):
        got, bend = np.zeros(k), np.zeros((k, k))
        for b in batches:
            p, cap, t = _matrix(b.column(0), k), b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            pull = p @ steps
            got += (np.clip(pull, 0, cap) * t) @ p
            free = t * ((pull > 0) & (pull < cap))
            bend += (p * free[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(got), pa.array(list(bend), pa.list_(pa.float64()))], ["i", "s", "b"])

    rows = table.select("p", "cap", "n_tokens").mapInArrow(run, "i int, s double, b array<double>")
    each = [F.sum(F.col("b")[j]).alias(f"b{j}") for j in range(k)]
    got, bend = np.zeros(k), np.zeros((k, k))
    for r in rows.groupBy("i").agg(F.sum("s").alias("s"), *each).toLocalIterator():
        got[r["i"]], bend[r["i"]] = r["s"], [r[f"b{j}"] for j in range(k)]
    return got, bend


def fit_rates(table: DataFrame, want: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed steps whose rates come closest to ``want`` in squares relative to it, and what is still lacking.

    Each step is the gradient, scaled by the curvature of the documents that are at neither bound. A step that
    makes it worse is halved. Ends when nothing is lacking, or when passes no longer help: then the caps do not
    allow more.
    """
    k = len(want)
    steps = np.divide(want, held, out=np.zeros(k), where=held > 0)
    best, idle, damp = None, 0, 1e-3
    while True:
        got, bend = _pass(table, k, steps)
        lack = want - got
        misfit = float(np.sum((lack / np.maximum(1.0, want.max())) ** 2))
        if best is None or misfit < best[0]:
            idle = 0 if best is None or misfit < (1 - IDLE) * best[0] else idle + 1
            best, damp = (misfit, steps, lack, bend), max(damp / 4, 1e-6)
        else:
            idle, damp = idle + 1, damp * 8
        if (np.abs(lack) <= TOLERANCE * np.maximum(1.0, want)).all() or idle >= IDLE_PASSES:
            return best[1], best[2]
        _, at, lack, bend = best
        steps = at + np.linalg.solve(bend + np.diag(damp * np.maximum(held, 1.0)), lack)


def _rounded(group: pd.DataFrame) -> pd.DataFrame:
    """Whole repeats for the documents of one source and rounding group, the longest first.

    What the fractions of rates are short of in tokens is carried on; a document that fits into it is
    used once more. So the tokens used fall short of the rates' by less than a short document.
    """
    group = group.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
    rate, size = group["rate"].to_numpy(), group["n_tokens"].to_numpy(float)
    base = np.floor(rate + 1e-9)
    parts = np.maximum(rate - base, 0.0)
    more, owed = np.zeros(len(group)), 0.0
    for i in range(len(group)):
        owed += parts[i] * size[i]
        if parts[i] > 0 and owed + 1e-6 >= size[i]:
            more[i], owed = 1, owed - size[i]
    return group[["doc_id", "n_tokens", "label", "p", "top", "cap"]].assign(repeats=(base + more).astype(int))


def settle(owed: np.ndarray, pool: list[tuple[int, int, int, int, int]]) -> dict[int, int]:
    """Changes of repeats, doc_id to +-n, that make up what each source is owed as nearly as the pool lets.

    ``pool`` has doc_id, source, n_tokens, repeats, cap. The change that leaves least is made until none helps.
    """
    out: dict[int, int] = {}
    for s, left in enumerate(owed):
        mine = [[d, n, r, c] for d, i, n, r, c in pool if i == s and n > 0]
        while mine:
            moves = [(abs(left - way * m[1]), m[0], way, m) for m in mine for way in (1, -1) if 0 <= m[2] + way <= m[3]]
            if not moves:
                break
            rest, doc, way, m = min(moves, key=lambda x: x[:3])
            if rest >= abs(left) - 1e-9:
                break
            left -= way * m[1]
            m[2] += way
            out[doc] = out.get(doc, 0) + way
    return {d: n for d, n in out.items() if n}


def mix(documents: DataFrame, targets: DataFrame, work: Workspace, total_tokens: int | None = None, path: str = TOKENIZER, per_source: int = TRAIN_PER_SOURCE, trust: float | None = TRUST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, predicted, n_tokens, repeats of each document that is used; the shares reached).

    ``total_tokens`` defaults to the most for which every source that labelled documents name can
    be expected to reach its share within the caps. The shares: source, target_share, reached_share, n_tokens, n_documents,
    most_repeats, tokens counted by the source a document names and by likelihood where it names none;
    expected_share and lacking_tokens are those of the fit, by likelihood for all. A document's cap is
    the least max_repeats of its plausible sources and of the one it names. ``source`` is the one it
    names, or the likeliest (``predicted``). Null texts and ids, and texts without tokens, are never used. A target that no
    labelled document names asks for nothing.
    mix_targets is a table of a few settings and is read by the driver; of equal names the first counts.
    """
    rows: dict[str, tuple[float, int]] = {}
    for r in targets.toLocalIterator():
        if r["source"] is not None:
            rows.setdefault(r["source"], (float(r["target_share"] or 0), int(r["max_repeats"] or 0)))
    names, k = list(rows), len(rows)
    spark = work.spark
    picked_schema = "doc_id long, source string, predicted boolean, n_tokens long, repeats int"
    share_schema = "source string, target_share double, reached_share double, n_tokens double, n_documents long, most_repeats int, expected_share double, lacking_tokens double"
    if not names:
        return spark.createDataFrame([], picked_schema), spark.createDataFrame([], share_schema)
    share, most = np.array([rows[n][0] for n in names]), np.array([rows[n][1] for n in names], float)
    caps = F.array(*[F.lit(float(m)) for m in most])
    docs = labelled(documents, names)
    model = train(docs.where("label is not null"), names, per_source)
    members = memberships(docs, model, path, trust).where("n_tokens > 0")
    plausible = F.array_min(F.transform(caps, lambda c, i: F.when(F.col("p")[i] >= PLAUSIBLE, c).otherwise(F.lit(float(most.max())))))
    table = work.save(members.withColumn("cap", F.least(plausible, F.get(caps, F.col("label")))))
    # At the largest step every document is at its cap, and at no source's step does it lack any.
    held, _ = _pass(table.withColumn("cap", F.lit(1.0)), k, np.ones(k))
    most_of, _ = _pass(table, k, np.full(k, most.max() + 1))
    named = np.zeros(k)
    for r in table.where("label is not null").groupBy("label").agg(F.sum(F.col("n_tokens") * F.col("cap")).alias("t")).toLocalIterator():
        named[r["label"]] = r["t"]
    can = (share > 0) & (named > 0)
    reach = min((min(m, n) / s for m, n, s, c in zip(most_of, named, share, can) if c), default=0.0)
    want = share * (reach if total_tokens is None else total_tokens) * can
    steps, lack = fit_rates(table, want, held)

    def rated(batches):
        for b in batches:
            p = np.stack(b["p"].to_list()) if len(b) else np.zeros((0, k))
            top = np.where(b["label"].isna(), p.argmax(axis=1), b["label"].fillna(0)).astype(int) if len(b) else []
            yield b[["doc_id", "n_tokens", "label", "p", "cap"]].assign(rate=_rates(p, b["cap"].to_numpy(float), steps), top=top)

    kinds = "doc_id long, n_tokens long, label int, p array<double>, cap double"
    rates = table.mapInPandas(rated, f"{kinds}, rate double, top int")
    groups = max(1, math.ceil(table.count() / ROUNDING_GROUP))
    rates = rates.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(groups)))
    counted = work.save(rates.groupBy("top", "group").applyInPandas(_rounded, "doc_id long, n_tokens long, label int, p array<double>, top int, cap double, repeats int"))
    # What each source got, by name where there is one, and what it is owed.
    got = np.zeros(k)
    for r in counted.where("repeats > 0").select("top", F.col("label").isNull().alias("soft"), (F.col("n_tokens") * F.col("repeats")).alias("n"), F.posexplode("p").alias("i", "q")).where("soft or i = top").groupBy("i").agg(F.sum(F.when(F.col("soft"), F.col("n") * F.col("q")).otherwise(F.col("n"))).alias("n")).toLocalIterator():
        got[r["i"]] = r["n"]
    place = Window.partitionBy("top", "class").orderBy(F.xxhash64("doc_id", F.lit("pool")), "doc_id")
    few = counted.where("label is not null").select("doc_id", "top", "n_tokens", "repeats", "cap", F.floor(F.log2("n_tokens")).alias("class")).withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= POOL)
    pool = [(r["doc_id"], r["top"], r["n_tokens"], r["repeats"], int(r["cap"])) for r in few.collect()]
    changes = settle(np.where(can, want - got, 0.0), pool)
    changed = spark.createDataFrame(list(changes.items()), "doc_id long, change int")
    fixed = counted.join(F.broadcast(changed), "doc_id", "left").withColumn("repeats", (F.col("repeats") + F.coalesce("change", F.lit(0))).cast("int"))
    known = F.array(*[F.lit(n) for n in names])
    used = work.save(fixed.select("doc_id", known[F.col("top")].alias("source"), F.col("label").isNull().alias("predicted"), "n_tokens", "repeats", "p").where("repeats > 0"))
    own = known[F.col("i")] == F.col("source")
    parts = used.select("repeats", "predicted", (F.col("repeats") * F.col("n_tokens")).alias("all"), F.posexplode("p").alias("i", "q"), "source")
    counts = F.when(F.col("predicted"), F.col("all") * F.col("q")).when(own, F.col("all")).otherwise(0.0)
    sums = parts.groupBy("i").agg(F.sum(counts).alias("n_tokens"), F.count(F.when(own, 1)).alias("n_documents"), F.max(F.when(own, F.col("repeats"))).alias("most_repeats"))
    goal = spark.createDataFrame([(i, n, float(s), float(e), float(d)) for i, (n, s, e, d) in enumerate(zip(names, share, (want - lack) / max(1e-9, float((want - lack).sum())), lack))], "i int, source string, target_share double, expected_share double, lacking_tokens double")
    every = sums.agg(F.sum("n_tokens").alias("every"))
    shares = goal.join(sums, "i", "left").join(F.broadcast(every)).select("source", "target_share", F.coalesce(F.col("n_tokens") / F.col("every"), F.lit(0.0)).alias("reached_share"), F.coalesce("n_tokens", F.lit(0.0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "expected_share", "lacking_tokens")
    return used.drop("p"), shares


def held_out(documents: DataFrame, targets: DataFrame, work: Workspace, per_source: int = TRAIN_PER_SOURCE) -> DataFrame:
    """source, n_held_out, n_told: how many of the held-out documents of each source the classifier tells by their texts alone."""
    names = list(dict.fromkeys(r["source"] for r in targets.toLocalIterator() if r["source"] is not None))
    model = train(labelled(documents, names).where("label is not null"), names, per_source) if names else None
    rows = [(n, *model.held_out.get(n, (0, 0))) for n in names]
    return work.spark.createDataFrame(rows, "source string, n_held_out int, n_told int")
