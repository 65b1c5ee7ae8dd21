"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens of a public vocabulary: a longer
one gives full pieces, which are bins of their own, and a rest. The rests are dealt by
hash into cells of about ``CELL`` pieces; each cell is packed by ``ISLANDS`` populations,
each in a task of its own. A chromosome is a list of bins. Crossover injects whole bins
of one parent, the best filled first, into the other; the bins there that hold an
injected piece go, and their other pieces are put back by best fit, largest first, after
an attempt to swap them for smaller ones in the bins that are left. Mutation empties the
worst filled bins the same way. An island's epoch goes on until ``PATIENCE`` children in a
row bring nothing better; then every island gets the next island's best chromosome in
place of its worst. A cell's evolution ends when an epoch after such a migration betters
its best chromosome (fewest bins, then most squared fill) on none of its islands, or where
no packing can be better: as few bins as the sum of its pieces allows, and all of them full
but one. No number of epochs or children is set. The start is best-fit decreasing, which
the result is never worse than.

``with_tokens`` puts the pieces' token ids to their bins.

Defined results
* null and empty texts have no token and are in no bin;
* null doc_id: the row is packed, named by the hash of its text only;
* very long texts: as many full pieces as they have;
* ties: equal pieces are ordered by doc_id and key, equal chromosomes by island;
* repeated rows: each row is packed, as pieces of the same doc_id, key and part; rows
  that share a doc_id but not the text are told apart by ``key``;
* empty tables give empty results; extra columns, whatever their names, are ignored;
* all random numbers come from the cell, island and epoch, so a task that is run
  again gives the same.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, key_of, ship, stored
from .kernel import slices
from .tokens import TOKENIZERS, VOCABULARY, tokenizer

#: Tokens to a bin.
CAPACITY = 2048
#: Pieces to a cell, islands to a cell, chromosomes to an island.
CELL, ISLANDS, POPULATION = 1024, 3, 4
#: Children in a row that bring nothing better, after which an island's epoch ends.
PATIENCE = 16

Bins = list[tuple[int, tuple[int, ...]]]


def best_fit(bins: Bins, pieces: list[int], size: list[int], capacity: int) -> Bins:
    """Put ``pieces``, given largest first, each into the bin that it fills best; a new bin where none has room."""
    out = list(bins)
    room = sorted((capacity - b[0], k) for k, b in enumerate(bins) if b[0] < capacity)
    for p in pieces:
        s = size[p]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, k = room.pop(at)
            load, held = out[k]
            out[k] = load + s, (*held, p)
        else:
            free, k = capacity, len(out)
            out.append((s, (p,)))
        if free > s:
            insort(room, (free - s, k))
    return out


def _fullest(b: tuple[int, tuple[int, ...]]) -> tuple[int, tuple[int, ...]]:
    return -b[0], b[1]


def _owner(bins: Bins, n: int) -> list[int]:
    """The bin of each piece."""
    out = [-1] * n
    for k, (_, held) in enumerate(bins):
        for p in held:
            out[p] = k
    return out


class _Offers:
    """What may go from a bin, by its pieces: first each alone, then each two, as the sums of their sizes. Most bins outlive
    many children, so their sums are kept, up to ``MOST`` bytes of them."""

    MOST = 8 << 20

    def __init__(self, size: list[int]):
        self.size, self.kept, self.bytes, self.people = size, {}, 0, {}

    def ranked(self, bins: Bins) -> Bins:
        """The bins of one of the population, the fullest first."""
        return self._of(0, bins, lambda: sorted(bins, key=_fullest))

    def owner(self, bins: Bins) -> list[int]:
        return self._of(1, bins, lambda: _owner(bins, len(self.size)))

    def _of(self, which: int, bins: Bins, made):
        found = self.people.get((which, id(bins)))
        if found is None or found[0] is not bins:
            if len(self.people) > 64:
                self.people = {}
            found = self.people[which, id(bins)] = bins, made()
        return found[1]

    def sums(self, held: tuple[int, ...]) -> bytes:
        found = self.kept.get(held)
        if found is None:
            z = [self.size[p] for p in held]
            found = array("q", z + [one + two for i, one in enumerate(z) for two in z[i + 1 :]]).tobytes()
            if self.bytes > self.MOST:
                self.kept, self.bytes = {}, 0
            self.kept[held] = found
            self.bytes += len(found)
        return found

    @staticmethod
    def named(held: tuple[int, ...], nth: int) -> tuple[int, ...]:
        """The pieces of the nth offer of a bin."""
        if nth < len(held):
            return (held[nth],)
        nth -= len(held)
        for i, one in enumerate(held):
            if nth < len(held) - 1 - i:
                return one, held[i + 1 + nth]
            nth -= len(held) - 1 - i
        raise IndexError


def swapped(bins: Bins, loose: list[int], size: list[int], capacity: int, offers: _Offers | None = None) -> tuple[Bins, list[int]]:
    """Put each loose piece of over a quarter of a bin, the largest first, in place of a smaller one (or two) of a bin that it
    then fills better; what it replaces is loose. Smaller pieces are left to best fit, which places them well."""
    large = [p for p in loose if 4 * size[p] > capacity]
    if not large:
        return bins, sorted(loose, key=lambda p: (-size[p], p))
    offers = offers or _Offers(size)
    bins, left = list(bins), [p for p in loose if 4 * size[p] <= capacity]
    where = [k for k, b in enumerate(bins) if b[0] < capacity]
    each = [offers.sums(bins[k][1]) for k in where]
    length = np.array([len(x) for x in each], np.int64) >> 3
    edges = length.cumsum()
    rooms = np.array([capacity - bins[k][0] for k in where], np.int64).repeat(length)
    # an offer's reach is its room after it went: the least that a piece fits in leaves least; of equal ones the first
    order = (rooms + np.frombuffer(b"".join(each), np.int64)) << 32 | np.arange(len(rooms))
    order.sort()
    reach, order = order >> 32, order & 0xFFFFFFFF
    rooms = rooms[order]
    place = None
    sizes = np.array([size[p] for p in large], np.int64)
    begin, end = reach.searchsorted(sizes).tolist(), reach.searchsorted(sizes + rooms.max(initial=0)).tolist()
    newest: dict[int, int] = {}  # bins whose pieces changed, and where their newest offers begin
    fresh: list[tuple[int, int, int, int]] = []  # offers of changed bins: reach, number, room, bin
    number = len(order)
    for p, a, b in zip(large, begin, end):
        s = size[p]
        k, least = -1, 1 << 62
        if a < b:
            # what goes must be smaller than the piece (reach - room < s), and the room, too
            free = rooms[a:b]
            good = (free > reach[a:b] - s) & (free < s)
            at = int(good.argmax())
            if good[at]:
                least, nth = int(reach[a + at]), int(order[a + at])
                i = int(edges.searchsorted(nth, side="right"))
                k, which = where[i], nth - int(edges[i] - length[i])
        for n in range(bisect_left(fresh, (s,)), len(fresh)):
            far, nth, room, j = fresh[n]
            if far >= least:
                break
            if far - s < room < s and nth >= newest[j]:
                k, which = j, nth - newest[j]
                break
        if k < 0:
            left.append(p)
            continue
        load, held = bins[k]
        out = offers.named(held, which)
        load, held = bins[k] = load + s - sum(size[o] for o in out), (*(o for o in held if o not in out), p)
        left += out
        if k not in newest:  # its first offers are gone: nothing fits there
            if place is None:
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
            rooms[place[edges[i] - length[i] : edges[i]]] = 0
        newest[k] = number
        if load < capacity:
            room = capacity - load
            for x in np.frombuffer(offers.sums(held), np.int64).tolist():
                insort(fresh, (room + x, number, room, k))
                number += 1
    left.sort(key=lambda p: (-size[p], p))
    return bins, left


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins, then fuller ones."""
    return -len(bins), sum(n * n for n, _ in bins) / capacity**2


def crossover(one: Bins, two: Bins, size: list[int], capacity: int, rng: np.random.Generator, offers: _Offers | None = None) -> Bins:
    """``two`` with whole well-filled bins of ``one`` injected."""
    ranked = offers.ranked(one) if offers else sorted(one, key=_fullest)
    few = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))]
    new = [b for b, r in zip(few, rng.random(len(few)).tolist()) if r < 0.7] or few[:1]
    there = {p for b in new for p in b[1]}
    owner = offers.owner(two) if offers else _owner(two, len(size))
    hit = {owner[p] for p in there}
    left = [b for k, b in enumerate(two) if k not in hit]
    loose = [p for k in hit for p in two[k][1] if p not in there]
    loose.sort(key=lambda p: (-size[p], p))
    return best_fit(*swapped(new + left, loose, size, capacity, offers), size, capacity)


def mutate(bins: Bins, size: list[int], capacity: int, rng: np.random.Generator, offers: _Offers | None = None) -> Bins:
    """Empty some of the worst filled bins and one other, and put their pieces back."""
    if len(bins) < 3:
        return bins
    ranked = sorted(bins)
    k = max(1, int(len(bins) * rng.uniform(0.02, 0.1)))
    other = int(rng.integers(k, len(ranked)))
    loose = [p for b in [*ranked[:k], ranked[other]] for p in b[1]]
    rank = dict(zip(loose, rng.uniform(0.8, 1.0, len(loose)).tolist()))
    loose.sort(key=lambda p: (-size[p] * rank[p], p))
    return best_fit(*swapped([b for i, b in enumerate(ranked) if i >= k and i != other], loose, size, capacity, offers), size, capacity)


def evolve(population: list[Bins], size: list[int], capacity: int, seed: tuple[int, ...], children: int = PATIENCE) -> list[Bins]:
    """One epoch, until so many children in a row bring nothing better than the best; best first."""
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // capacity)
    offers = _Offers(size)
    people = sorted(((fitness(b, capacity), b) for b in population), key=lambda x: x[0], reverse=True)
    idle = 0
    while idle < children:
        best, bins = people[0]
        if len(bins) <= least and sum(n < capacity for n, _ in bins) <= 1:
            break  # no packing is better
        i, j = rng.choice(len(people), 2, replace=False)
        child = mutate(crossover(people[i][1], people[j][1], size, capacity, rng, offers), size, capacity, rng, offers)
        people.append((fitness(child, capacity), child))
        people.sort(key=lambda x: x[0], reverse=True)
        people.pop()
        idle = 0 if people[0][0] > best else idle + 1
    return [b for _, b in people]


def first_population(size: list[int], capacity: int, seed: tuple[int, ...], n: int = POPULATION) -> list[Bins]:
    """Best-fit decreasing, and best fit in orders that are nearly decreasing."""
    rng = np.random.default_rng(seed)
    out = [best_fit([], sorted(range(len(size)), key=lambda p: (-size[p], p)), size, capacity)]
    for _ in range(n - 1):
        noise = rng.uniform(0.6, 1.0, len(size))
        out.append(best_fit([], sorted(range(len(size)), key=lambda p: (-size[p] * noise[p], p)), size, capacity))
    return out


def _count_batches(folder: str, vocabulary: str):
    def run(batches):
        tok = tokenizer(folder, vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                _, rows, _, count = tok.pieces(part.column(2))
                total = np.diff(np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[rows])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total)], ["doc_id", "key", "n"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), key_of(text).alias("key"), text.alias("text"))


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, key, part, n_tokens): part k of a row's text begins at token k * capacity; key is the hash of the text."""
    counted = arrow_map(_texts(docs), _count_batches(folder, vocabulary), "doc_id long, key long, n long").where("n > 0")
    return counted.select("doc_id", "key", F.col("n").alias("all"), F.explode(F.expr(f"sequence(0, (n - 1) div {capacity})")).alias("part")).select(
        "doc_id", "key", F.col("part").cast("long").alias("part"), F.least(F.lit(capacity), F.col("all") - F.col("part") * capacity).cast("long").alias("n_tokens")
    )


def _begin(capacity: int, islands: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "named", "doc_id", "key", "part"], ascending=[False, False, True, True, True])
        cell = int(pdf.cell.iloc[0])
        blob = pickle.dumps(tuple(pdf[c].to_numpy() for c in ("named", "doc_id", "key", "part", "n_tokens")))
        return pd.DataFrame([{"cell": cell, "island": k, "items": blob, "population": None, "best": None} for k in range(islands)])

    return run


def _epoch(capacity: int, epoch: int):
    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                size = pickle.loads(r.items)[4].tolist()
                people = pickle.loads(r.population) if r.population is not None else first_population(size, capacity, (int(r.cell), int(r.island)))
                if r.best is not None:  # the neighbour's elite in place of the worst
                    people[-1] = pickle.loads(r.best)
                people = evolve(people, size, capacity, (int(r.cell), int(r.island), epoch + 1))
                fit = fitness(people[0], capacity)
                rows.append((r.cell, r.island, r.items, pickle.dumps(people), pickle.dumps(people[0]), r.top, fit[0], fit[1]))
            yield pd.DataFrame(rows, columns=["cell", "island", "items", "population", "best", "top", "fewest", "fill"])

    return run


def _unpacked(frames):
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            named, doc, key, part, size = pickle.loads(r.items)
            for k, (load, held) in enumerate(pickle.loads(r.best)):
                out += [(f"c{r.cell}-{k}", bool(named[p]), int(doc[p]), int(key[p]), int(part[p]), int(size[p]), load) for p in held]
        yield pd.DataFrame(out, columns=["bin", "named", "doc_id", "key", "part", "n_tokens", "bin_tokens"])


def packed(docs: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS) -> DataFrame:
    """(bin, doc_id, key, part, first_token, n_tokens, bin_tokens): every piece and its bin."""
    ship(docs.sparkSession)
    all_ = stored(pieces(docs, capacity), "pieces")
    full = all_.where(F.col("n_tokens") == capacity).groupBy("doc_id", "key", "part").agg(F.count(F.lit(1)).alias("rows"))
    full = full.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    full = full.select(F.concat_ws("-", F.lit("f"), "doc_id", F.hex("key"), "part", "row").alias("bin"), "doc_id", "key", "part", F.lit(capacity).cast("long").alias("n_tokens"), F.lit(capacity).cast("long").alias("bin_tokens"))
    rest = all_.where(F.col("n_tokens") < capacity)
    n = rest.count()
    cells = max(1, -(-n // cell))
    # copies of a row are dealt to different cells: by what they are and by the task that read them
    rest = rest.withColumn("named", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    same = rest.groupBy("named", "doc_id", "key", "part", "n_tokens").agg(F.count(F.lit(1)).alias("rows")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
    dealt = same.select("named", "doc_id", "key", "part", "n_tokens", F.pmod(F.xxhash64("doc_id", "key", "part", "row"), F.lit(cells)).cast("long").alias("cell"))
    state_schema = "cell long, island int, items binary, population binary, best binary"
    state = dealt.groupBy("cell").applyInPandas(_begin(capacity, islands), state_schema).withColumn("top", F.lit(None).cast("struct<fewest:int,fill:double>"))
    done_schema = state_schema + ", top struct<fewest:int,fill:double>, fewest int, fill double"
    settled, epoch = [], 0
    ring = Window.partitionBy("cell").orderBy("island")
    while True:
        state = state.repartition(F.col("cell"), F.col("island"))  # the islands of a cell evolve in different tasks
        state = stored(state.mapInPandas(_epoch(capacity, epoch), done_schema), "islands")
        now = F.max(F.struct("fewest", "fill")).over(Window.partitionBy("cell"))
        state = state.withColumn("now", now).withColumn("open", F.col("top").isNull() | (F.col("now") > F.col("top")))
        settled.append(state.where("not open").groupBy("cell").agg(F.max_by(F.struct("items", "best"), F.struct("fewest", "fill", -F.col("island"))).alias("b")).select("cell", "b.items", "b.best"))
        state = state.where("open")
        if state.isEmpty():
            break
        next_ = F.coalesce(F.lead("best").over(ring), F.first("best").over(ring))
        state = state.select("cell", "island", "items", "population", next_.alias("best"), F.col("now").alias("top"))
        epoch += 1
    won = reduce(DataFrame.unionByName, settled)
    bins = won.mapInPandas(_unpacked, "bin string, named boolean, doc_id long, key long, part long, n_tokens long, bin_tokens long").withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")
    return bins.unionByName(full).select("bin", "doc_id", "key", "part", (F.col("part") * capacity).alias("first_token"), "n_tokens", "bin_tokens")


def _token_batches(capacity: int, folder: str, vocabulary: str):
    def run(batches):
        tok = tokenizer(folder, vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens, length = tok.encode_all(part.column(2))
                count = -(-length // capacity)
                row = np.repeat(np.arange(len(count)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = np.concatenate([np.repeat(np.cumsum(length) - length, count) + nth * capacity, [len(tokens)]]).astype(np.int32)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(nth.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(tokens.astype(np.int32)))], ["doc_id", "key", "part", "tokens"])

    return run


def with_tokens(docs: DataFrame, bins: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``bins``, as ``packed`` made them of ``docs``, with the token ids of each piece in ``tokens``."""
    # keys without a null, the same for both steps, so that the tokens are moved once
    on = ["__id", "__named", "key", "part"]
    keyed = lambda d: d.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__named", F.col("doc_id").isNotNull())
    ids = keyed(arrow_map(_texts(docs), _token_batches(capacity, folder, vocabulary), "doc_id long, key long, part long, tokens array<int>")).select(*on, "tokens").dropDuplicates(on)
    return keyed(bins).join(ids, on).select(*bins.columns, "tokens")
