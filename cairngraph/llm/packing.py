"""Items put into containers of a fixed capacity by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into another, drops
the bins that hold an injected item a second time and best-fits what they held besides. Items are dealt
into blocks of bounded size; on each block several islands evolve solutions of their own and hand
their best to the next island between epochs. Bins that are not well filled are dissolved and their
items dealt into new, fewer blocks, until each capacity has one block left.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.tokens import TOKENIZER, document_sizes
from cairngraph.workspace import Workspace

BLOCK_ITEMS = 384
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 12
POPULATION = 6
#: Share of the capacity from which a bin is well filled and kept for good.
WELL_FILLED = 0.985


class Bins:
    """Open bins by free room; puts an item where the least room is left."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.fill, self.room = capacity, [], [], []

    def add_bin(self, items: list[int], size: int) -> None:
        self.bins.append(items)
        self.fill.append(size)
        if size < self.capacity:
            insort(self.room, (self.capacity - size, len(self.bins) - 1))

    def put(self, item: int, size: int) -> None:
        k = bisect_left(self.room, (size, -1))
        if k == len(self.room):
            self.add_bin([item], size)
            return
        free, b = self.room.pop(k)
        self.bins[b].append(item)
        self.fill[b] += size
        if free > size:
            insort(self.room, (free - size, b))


def best_fit(sizes: list[int], order: list[int], capacity: int, kept: list[list[int]] | None = None) -> list[list[int]]:
    out = Bins(capacity)
    for b in kept or []:
        out.add_bin(list(b), sum(sizes[i] for i in b))
    for i in order:
        out.put(i, sizes[i])
    return out.bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> float:
    """Mean square of how full the bins are: fewer bins, and rather one empty than two half full."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], first: list[list[int]], second: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    fill = sorted(((sum(sizes[i] for i in b), k) for k, b in enumerate(second)), reverse=True)
    best = [k for _, k in fill[: max(1, len(fill) // 2)]]
    injected = [second[k] for k in rng.sample(best, max(1, len(best) // 2))]
    taken = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in first:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced.extend(i for i in b if i not in taken)
    return best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), capacity, kept)


def mutate(sizes: list[int], bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bin and a few others, and best-fits their items in a shaken order."""
    if len(bins) < 3:
        return bins
    worst = min(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = {worst, *rng.sample(range(len(bins)), min(len(bins) - 1, 1 + len(bins) // 12))}
    loose = [i for k in gone for i in bins[k]]
    loose.sort(key=lambda i: -sizes[i] * rng.uniform(0.8, 1.25))
    return best_fit(sizes, loose, capacity, [b for k, b in enumerate(bins) if k not in gone])


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], guest: list[list[int]] | None, seed: int) -> list[list[list[int]]]:
    """One epoch of one island; the population comes back best first."""
    rng = random.Random(seed)
    least = max(1, -(-sum(sizes) // capacity))
    if not population:
        down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        population = [best_fit(sizes, down, capacity)]
        while len(population) < POPULATION:
            population.append(best_fit(sizes, sorted(down, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.4)), capacity))
    if guest:
        population = [*population, guest]
    scored = sorted(((fitness(sizes, p, capacity), -n, p) for n, p in enumerate(population)), key=lambda x: x[:2], reverse=True)[:POPULATION]
    for g in range(GENERATIONS):
        # As few bins as can be, and at most the last one with room: nothing is left to gain.
        if len(scored[0][2]) == least and sum(capacity - sum(sizes[i] for i in b) > (1 - WELL_FILLED) * capacity for b in scored[0][2]) <= 1:
            break
        one, other = (min(rng.sample(range(len(scored)), min(2, len(scored)))) for _ in range(2))
        child = crossover(sizes, scored[one][2], scored[other][2], capacity, rng)
        if one == other or rng.random() < 0.5:
            child = mutate(sizes, child, capacity, rng)
        f = fitness(sizes, child, capacity)
        if f > scored[-1][0] and all(abs(f - s[0]) > 1e-12 for s in scored):
            scored = sorted([*scored[:-1], (f, -1000 - g, child)], key=lambda x: x[:2], reverse=True)
    return [s[2] for s in scored]


STATE = "name string, capacity int, block long, island int, ids array<struct<doc_id:bigint,piece:int,start:bigint>>, sizes array<int>, population array<array<array<int>>>, score double"


def _epoch(state: DataFrame, number: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                plain = lambda p: [[int(i) for i in b] for b in p]
                people = [plain(p) for p in r.population] if r.population is not None else []
                guest = plain(r.guest) if r.guest is not None else None
                found = evolve(sizes, int(r.capacity), people, guest, hash((int(r.block), int(r.island), number)))
                out.append(found)
            yield batch.drop(columns=["guest"]).assign(population=out, score=[fitness([int(x) for x in s], p[0], int(c)) for s, p, c in zip(batch["sizes"], out, batch["capacity"])])

    return state.mapInPandas(run, STATE)


def _round(items: DataFrame, counts: dict[str, int], turn: int, work: Workspace) -> tuple[DataFrame, bool]:
    """Packs items block by block: name, capacity, block, bin, items (array), fill; and whether each name is one block."""
    blocks = {n: max(1, math.ceil(c / BLOCK_ITEMS)) for n, c in counts.items()}
    of = F.create_map(*[x for n, b in blocks.items() for x in (F.lit(n), F.lit(b))])
    entry = F.struct("doc_id", "piece", "start", "size")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), of[F.col("name")]))
    grouped = dealt.groupBy("name", "capacity", "block").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    state = grouped.select("name", "capacity", "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.transform("e", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.start.alias("start"))).alias("ids"), F.col("e.size").alias("sizes"), F.lit(None).cast("array<array<array<int>>>").alias("population"), F.lit(0.0).alias("score"))
    # Blocks take like long; one task gets a few of them.
    tasks = max(1, min(sum(blocks.values()) * ISLANDS, 4 * work.spark.sparkContext.defaultParallelism + sum(blocks.values()) // 32))
    state = state.repartition(tasks, "name", "block", "island")
    for epoch in range(EPOCHS):
        if epoch:
            best = state.select("name", "block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("guest"))
            state = state.join(best, ["name", "block", "island"])
        else:
            state = state.withColumn("guest", F.lit(None).cast("array<array<int>>"))
        state = work.save(_epoch(state.select("name", "capacity", "block", "island", "ids", "sizes", "population", "score", "guest"), epoch))
    top = state.groupBy("name", "capacity", "block").agg(F.max_by(F.struct("ids", "sizes", F.col("population")[0].alias("bins")), F.struct("score", -F.col("island"))).alias("s"))
    bins = top.select("name", "capacity", "block", "s.ids", "s.sizes", F.posexplode("s.bins").alias("bin", "members"))
    bins = bins.select("name", "capacity", "block", "bin", F.transform("members", lambda i: F.struct(F.element_at("ids", i + 1).alias("id"), F.element_at("sizes", i + 1).alias("size"))).alias("items"))
    bins = bins.withColumn("fill", F.aggregate("items", F.lit(0), lambda a, x: a + x.size))
    return work.save(bins), all(b == 1 for b in blocks.values())


def pack_documents(sizes: DataFrame, capacities: dict[str, int], work: Workspace) -> DataFrame:
    """container, bin_id, doc_id, piece, start_token, n_tokens: where each document is, for each capacity.

    ``sizes`` has doc_id (unique) and n_tokens. A document longer than a capacity is cut into pieces that
    fill a bin each, and a rest that is packed like the others; no other is cut. Documents of no tokens
    need no room and are left out, as are capacities below 1. No documents give no rows.
    """
    capacities = {n: c for n, c in capacities.items() if n is not None and c and c >= 1}
    schema = "container string, bin_id string, doc_id long, piece int, start_token long, n_tokens int"
    if not capacities:
        return work.spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("capacity")) for n, c in capacities.items()]))
    docs = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", each.alias("c")).select("doc_id", "n_tokens", "c.name", "c.capacity")
    whole = docs.where("n_tokens >= capacity").select("name", "doc_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n_tokens") / F.col("capacity")) - 1).cast("int"))).alias("piece"), F.col("capacity"))
    done = [whole.select(F.col("name").alias("container"), F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))]
    rest = docs.withColumn("size", (F.col("n_tokens") % F.col("capacity")).cast("int")).where("size > 0")
    items = work.save(rest.select("name", "capacity", "doc_id", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int").alias("piece"), (F.col("n_tokens") - F.col("size")).alias("start"), "size"))
    turn = 0
    while counts := {r["name"]: r["count"] for r in items.groupBy("name").count().toLocalIterator()}:
        bins, last = _round(items, counts, turn, work)
        if last:
            kept, items = bins, None
        else:
            # Where few bins come out well filled, the fuller half is kept, so that every turn leaves less.
            half = {r["name"]: min(WELL_FILLED, r["f"]) for r in bins.groupBy("name").agg(F.percentile_approx(F.col("fill") / F.col("capacity"), 0.5, 1000).alias("f")).toLocalIterator()}
            floor = F.create_map(*[x for n, f in half.items() for x in (F.lit(n), F.lit(f))])[F.col("name")]
            full = F.col("fill") / F.col("capacity") >= floor
            kept = bins.where(full)
            items = bins.where(~full)
        out = kept.select("name", F.concat_ws("-", F.lit(str(turn)), "block", "bin").alias("bin_id"), F.explode("items").alias("i"))
        done.append(out.select(F.col("name").alias("container"), "bin_id", "i.id.doc_id", "i.id.piece", F.col("i.id.start").alias("start_token"), F.col("i.size").alias("n_tokens")))
        if items is None:
            break
        items = work.save(items.select("name", "capacity", F.explode("items").alias("i")).select("name", "capacity", "i.id.doc_id", "i.id.piece", "i.id.start", "i.size"))
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def container_list(containers: DataFrame) -> dict[str, int]:
    """The containers' capacities; a table of a few settings, read by the driver."""
    return {r["name"]: r["capacity_tokens"] for r in containers.toLocalIterator()}


def pack_texts(documents: DataFrame, containers: DataFrame, work: Workspace, path: str = TOKENIZER) -> DataFrame:
    """``pack_documents`` for texts measured with a tokenizer; null texts are left out."""
    return pack_documents(work.save(document_sizes(documents, path=path)), container_list(containers), work)


def packing_summary(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """container, capacity, n_bins, least_bins (no packing has fewer), n_tokens, filled (share of the room used)."""
    of = F.create_map(*[x for n, c in capacities.items() for x in (F.lit(n), F.lit(c))])
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("fill"))
    rows = bins.groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("fill").alias("n_tokens")).withColumn("capacity", of[F.col("container")])
    return rows.select("container", "capacity", "n_bins", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), "n_tokens", (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("filled"))
