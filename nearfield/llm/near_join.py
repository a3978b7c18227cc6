"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import pieces, stored, table, texts_of

#: Hash functions in a tree's label, the deepest prefix that the forest can match.
DEPTH = 8
#: Places of a signature, a byte each, that travel with each label, to tell likely links from chance meetings.
SKETCH = 40


def agreement(similarity: float, least: int, places: int = SKETCH) -> float:
    """The probability that at least `least` places of two texts' sketches agree: each does where the minima are the same,
    and else in one of 256 cases."""
    p = similarity + (1 - similarity) / 256
    return sum(math.comb(places, i) * p**i * (1 - p) ** (places - i) for i in range(least, places + 1))


def forest_depth(trees: int, similarity: float, recall: float, least: int = 0, deepest: int = DEPTH) -> int:
    """The longest prefix at which two texts of this similarity meet in some tree, and are tied there, with probability
    `recall`: (1 - (1 - s^k)^trees) times the agreement of their sketches. This is where shortening ends for texts that
    are tied to nothing on the way."""
    k = deepest
    while k > 1 and (1 - (1 - similarity**k) ** trees) * agreement(similarity, least) < recall:
        k -= 1
    return k


class Shingler:
    """Sorted distinct 64-bit hashes of a text's runs of n words; a text of fewer words, but not none, is one run.

    Words are what white space parts, A-Z lower-cased.
    """

    def __init__(self, n: int) -> None:
        import xxhash

        self.n = n
        rng = np.random.default_rng(5)
        self.times = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        digest = xxhash.xxh64_intdigest

        class Known(dict):
            def __missing__(self, w: bytes) -> int:
                if len(self) > 250_000:
                    self.clear()
                v = self[w] = digest(w)
                return v

        self.known = Known()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        w = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.n, len(w))
        size = len(w) - k + 1
        h = np.full(size, k, dtype=np.uint64)
        for j in range(k):
            h += w[j : j + size] * self.times[j]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return np.unique(h)


class MinHash:
    """`size` minima of a set under hash functions a * x + b modulo 2**32."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng(11)
        self.a = (rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, size, dtype=np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(out, (self.a * x[i : i + 2048] + self.b).min(1), out=out)
        return out


def signatures(rows: DataFrame, trees: int, n: int) -> DataFrame:
    """(row, id, a, b, size, sig): the 128-bit key of each text's shingle set, its size, and its minima. Texts without words get a key of
    their own and no signature, as they are like nothing."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingle, minima = Shingler(n), MinHash(trees * DEPTH)
        for batch in pieces(batches, 2):
            a, b, size, sig = [], [], [], []
            for row, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), strict=True):
                h = shingle(t)
                size.append(len(h))
                if not len(h):
                    a.append(row)
                    b.append(-1)
                    sig.append(None)
                    continue
                d = np.frombuffer(xxhash.xxh128_digest(h.tobytes()), dtype=np.int64)
                a.append(int(d[0]))
                b.append(int(d[1]))
                sig.append(minima(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["row", "id", "a", "b", "size", "sig"])

    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, a long, b long, size long, sig binary")


class Trie:
    """Walks one subtree of a tree's prefix trie, from its deepest prefixes up to its root.

    Texts of one prefix are compared by their sketches with the leaders found under that prefix so far: those that agree
    in `tie` places are tied (a spanning forest: an edge for each text and group that it joins). A text that agrees with a
    leader in `near` places is done, the leader stands for it; all others become leaders and have their prefix shortened
    by one, where they meet the leaders of the next wider group, and so on to the root.
    """

    def __init__(self, tie: int, near: int) -> None:
        self.tie, self.near = tie, near
        self.u: list[int] = []
        self.v: list[int] = []

    def merge(self, groups: list[np.ndarray], sketch: np.ndarray, names: np.ndarray, group_of: np.ndarray) -> np.ndarray:
        """The leaders, as positions, of groups whose own leaders meet for the first time."""
        leaders = groups[0]
        for g in groups[1:]:
            new = []
            for lo in range(0, len(g), 64):
                some = g[lo : lo + 64]
                alike = (sketch[some][:, None, :] == sketch[leaders][None]).sum(2)
                for i, row in zip(some.tolist(), alike, strict=True):
                    at = np.flatnonzero(row >= self.tie)
                    for other in np.unique(group_of[leaders[at]]):
                        if other != group_of[i]:
                            self.u.append(int(names[i]))
                            self.v.append(int(names[leaders[at[group_of[leaders[at]] == other][0]]]))
                            group_of[group_of == other] = group_of[i]
                    if not len(at) or row.max() < self.near:
                        new.append(i)
            if new:
                leaders = np.concatenate([leaders, np.array(new)])
        return leaders

    def walk(self, labels: np.ndarray, sketch: np.ndarray, names: np.ndarray) -> np.ndarray:
        """labels: (texts, places below the root), sorted. The positions of the texts that lead at the root."""
        group_of = np.arange(len(names))

        def climb(lo: int, hi: int, depth: int) -> np.ndarray:
            """The leaders of the texts lo to hi, which share `depth` places."""
            if hi - lo == 1:
                return np.array([lo])
            if depth == labels.shape[1]:
                children = [np.array([i]) for i in range(lo, hi)]
            else:
                cuts = np.flatnonzero(np.diff(labels[lo:hi, depth]) != 0) + lo + 1
                children = [climb(a, b, depth + 1) for a, b in zip([lo, *cuts.tolist()], [*cuts.tolist(), hi], strict=True)]
            return self.merge(children, sketch, names, group_of)

        return climb(0, len(names), 0)


def candidate_edges(reps: DataFrame, trees: int, depth: int, tie: int, near: int) -> DataFrame:
    """Distinct (u, v) pairs that join every bucket's likely links.

    Each tree is a trie of labels of DEPTH minima. Every task first walks the tries of its own texts, a few thousand at a
    time, so of a group of copies a leader or so for each task goes on. Leaders' labels are dealt by tree and prefix of
    `depth`, where shortening ends, and sorted, so that a subtree lies side by side, and are walked again. What a task
    holds is one subtree's leaders.
    """
    below = DEPTH - depth

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rng = np.random.default_rng(23)
        times = rng.integers(1, 2**63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(len(rows), trees, DEPTH)
            key = ((sig[:, :, :depth].astype(np.uint64) * times[:depth]).sum(2) + np.arange(trees, dtype=np.uint64) * times[0]).view(np.int64)
            flat = sig.reshape(len(rows), -1)
            sketch = np.ascontiguousarray(flat[:, :: max(1, flat.shape[1] // SKETCH)][:, :SKETCH].astype(np.uint8))
            trie = Trie(tie, near)
            for t in range(trees):
                rest = sig[:, t, depth:]
                order = np.lexsort((rows, *(rest[:, j] for j in range(below - 1, -1, -1)), key[:, t]))
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(key[order, t]) != 0, [True])))
                many = np.flatnonzero(np.diff(cuts) > 1)
                lead = np.ones(len(rows), dtype=bool)
                for a, b in zip(cuts[many].tolist(), cuts[many + 1].tolist(), strict=True):
                    own = order[a:b]
                    lead[own] = False
                    lead[own[trie.walk(rest[own], sketch[own], rows[own])]] = True
                lead = np.flatnonzero(lead)
                sort = [x.tobytes() for x in rest[lead].astype(">u4")]
                yield pa.RecordBatch.from_arrays([pa.array(rows[lead]), pa.nulls(len(lead), pa.int64()), pa.array(key[lead, t]), pa.array(sort, pa.binary()), pa.array([x.tobytes() for x in sketch[lead]], pa.binary())], ["row", "to", "key", "rest", "sketch"])
            none = pa.nulls(len(trie.u), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(trie.u, pa.int64()), pa.array(trie.v, pa.int64()), pa.array(trie.u, pa.int64()), none, none], ["row", "to", "key", "rest", "sketch"])

    def second(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list[tuple[np.ndarray, ...]] = []  # the last subtree so far, which may go on in the next batch

        def walk(trie: Trie, parts: list[tuple[np.ndarray, ...]]) -> None:
            _, names, rest, sketch = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            if len(names) > 1:
                trie.walk(rest, sketch, names)

        for batch in batches:
            trie = Trie(tie, near)
            known = batch.filter(pc.is_valid(batch.column(1)))
            yield pa.RecordBatch.from_arrays([known.column(0), known.column(1)], ["u", "v"])
            batch = batch.filter(pc.is_null(batch.column(1)))
            if not batch.num_rows:
                continue
            key, names = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            rest = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=">u4").reshape(len(names), below) if below else np.zeros((len(names), 0), np.uint32)
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(len(names), SKETCH)
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0, [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = (key[a:b], names[a:b], rest[a:b], sketch[a:b])
                if held and held[0][0][0] == key[a]:
                    held.append(part)
                else:
                    if held:
                        walk(trie, held)
                    held = [part]
            yield pa.RecordBatch.from_arrays([pa.array(trie.u, pa.int64()), pa.array(trie.v, pa.int64())], ["u", "v"])
        if held:
            walk(trie := Trie(tie, near), held)
            yield pa.RecordBatch.from_arrays([pa.array(trie.u, pa.int64()), pa.array(trie.v, pa.int64())], ["u", "v"])

    # edges that are known travel with the labels, to be sent once
    dealt = reps.mapInArrow(first, "row long, to long, key long, rest binary, sketch binary").repartition("key").sortWithinPartitions("key", "rest", "row")
    return stars(dealt.mapInArrow(second, "u long, v long"))


def stars(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) pairs that connect what edges connect. Each u keeps the edge to its least neighbour, on which its
    others are hung, so the ties of a group to leaders that differ by tree fall together. Edges to a text that leads are
    its followers' own, so the set gathered for one u has the groups that it joined, some for each tree."""
    near = edges.where("u <> v").groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    hung = F.transform(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0))), lambda x: F.struct(F.element_at("vs", 1).alias("u"), x.alias("v")))
    every = F.concat(F.array(F.struct("u", F.element_at("vs", 1).alias("v"))), hung)
    return near.select(F.explode(every).alias("e")).select("e.u", "e.v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the node's component. Least labels spread along edges and jump to the
    label's label, until nothing changes; each round is written out, so none is computed again."""
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct().where("u <> v"), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("to"))
        jump = step.join(labels.select(F.col("node").alias("to"), F.col("label").alias("further")), "to", "left")
        new = stored(jump.select("node", "before", F.least("to", F.coalesce("further", "to")).alias("label")), "labels")
        changed = new.where("label <> before").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def verify(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """texts: (unit, side, row, copies, text), a unit's rows together. (row, parent, links) for each row of a unit: the
    number of documents of other texts in the unit that it links to, and the least row that links lead to."""
    from fractions import Fraction

    need = Fraction(similarity).limit_denominator(1000)  # i / (a + b - i) >= p / q, in whole numbers
    p, q = need.numerator, need.denominator

    def links(rows: list[tuple], shingle: Shingler) -> tuple[list, list, list]:
        sets = [shingle(r[4]) for r in rows]
        sizes = np.array([len(s) for s in sets])
        side = np.array([r[1] for r in rows])
        who = np.repeat(np.arange(len(rows)), sizes)
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(at, minlength=len(every)) > 1
        new = np.cumsum(often) - 1
        who, at = who[often[at]], new[at[often[at]]]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        width = 2048
        common = np.zeros((len(rows), len(rows)), dtype=np.float32)
        cuts = np.searchsorted(at, np.arange(0, int(often.sum()) + width, width))
        for j, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            m = np.zeros((len(rows), width), dtype=np.float32)
            m[who[lo:hi], at[lo:hi] - j * width] = 1
            common += m @ m.T
        linked = (p + q) * common.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if (side == 1).any():  # two blocks: pairs within one are another unit's
            linked &= side[:, None] != side[None, :]
        copies = np.array([r[3] for r in rows])
        count = (linked * copies).sum(1)
        names = np.array([r[2] for r in rows])
        parent = names.copy()
        while True:
            least = np.minimum(parent, np.where(linked, parent[None, :], np.iinfo(np.int64).max).min(1))
            if (least == parent).all():
                return names.tolist(), parent.tolist(), count.tolist()
            parent = least

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingle = Shingler(n)
        unit, rows = None, []
        out: tuple[list, list, list] = ([], [], [])

        def pack():
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "parent", "links"])
            for x in out:
                x.clear()
            return b

        def done():
            for x, y in zip(out, links(rows, shingle), strict=True):
                x.extend(y)

        for batch in pieces(batches, 4):
            for r in zip(*[c.to_pylist() for c in batch.columns[:4]], texts_of(batch.column(4)), strict=True):
                if r[0] != unit:
                    if len(rows) > 1:
                        done()
                    unit, rows = r[0], []
                rows.append(r)
            yield pack()
        if len(rows) > 1:
            done()
        yield pack()

    return texts.mapInArrow(run, "row long, parent long, links long")


def by_label(rows: DataFrame, facts: DataFrame, size: str, total: int, on: list[str]) -> DataFrame:
    """rows with the facts of their label. A label of a ten-thousandth of all rows or more (of which there are ten thousand
    at most, and `size` is its number of rows) is broadcast; the others are joined by a shuffle, in which none is hot."""
    cut = max(total // 10_000, 64)
    hot = F.broadcast(facts.where(F.col(size) >= cut))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(facts.where(F.col(size) < cut), on))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, n: int = 5, trees: int = 20, recall: float = 0.999, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents joined by Jaccard similarity of their word shingles, one row per document.

    Documents of one shingle set are copies: they go on as one. A forest of `trees` sorted tries of MinHash labels proposes
    pairs: matching starts at the deepest prefix, and prefixes of texts that are tied to nothing near are shortened until
    `recall` is met for pairs at the threshold (0.999: of a thousand such pairs, one meets in no tree or is not told from
    chance by its sketch; closer pairs are missed less, and a pair is verified also where others connect its texts).
    Proposed pairs join into candidate components; in each, every pair is verified exactly on the whole texts. A component
    of more than `block` texts, or of over two million words, is verified in blocks, each pair of blocks a task's unit of
    its own, so that no task holds a group and no pair is ever a row; its texts travel once for each other block.

    Returns id_col, class_id (the least id of the documents that links connect), n_links (documents, copies included,
    that are at least so similar), kept (true for one document of each class), a row for each row of docs. Texts
    without words link to nothing. A text of any length is one set of hashes, eight bytes a word. A null id never names a
    class unless all its ids are null, and rows that repeat an id are documents each; ties for kept go to the first row.
    An empty table gives no rows. Other columns of docs are not read, whatever their names. docs has to be a table or a
    plan whose rows come in the same order each time, as rows are numbered in two reads.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(rows, trees, n), "signatures")
    total = signed.count()
    reps = stored(signed.groupBy("a", "b").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size")), "classes")
    first = signed.select("row", "sig").where("sig is not null").join(reps.select(F.col("rep").alias("row")), "row")
    tie, near = math.ceil((0.8 * similarity - 0.1) * SKETCH), math.ceil(similarity * SKETCH)
    edges = candidate_edges(first, trees, forest_depth(trees, similarity, recall, tie), tie, near)
    groups = components(edges)
    own = groups.join(reps.select(F.col("rep").alias("node"), "copies", "size"), "node")
    own = stored(own, "grouped")
    sized = own.groupBy("label").agg(F.count("*").alias("m"), F.sum("size").alias("words"))
    sized = stored(sized.select("label", "m", F.ceil(F.greatest(F.col("m") / block, F.col("words") / 2_000_000)).cast("int").alias("g")), "sized")
    placed = by_label(own, sized, "m", total, ["label"]).withColumn("b", F.expr("cast(pmod(xxhash64(node), g) as int)"))
    near_ = rows.select("row", "text").join(placed.select(F.col("node").alias("row"), "copies", "label", "g", "b"), "row").withColumn("j", F.explode(F.expr("sequence(0, g - 1)")))
    units = near_.select(F.concat_ws("-", "label", F.least("b", "j"), F.greatest("b", "j")).alias("unit"), (F.col("b") > F.col("j")).cast("int").alias("side"), "row", "copies", "text")
    found = stored(verify(units.repartition("unit").sortWithinPartitions("unit", "side", "row"), n, similarity), "verified")
    joined = components(found.select(F.col("row").alias("u"), F.col("parent").alias("v")).where("u <> v"))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    classes = reps.join(joined.select(F.col("node").alias("rep"), "label"), "rep", "left").join(links.select(F.col("row").alias("rep"), "links"), "rep", "left")
    classes = classes.select("a", "b", "copies", F.coalesce("label", "rep").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = by_label(signed.select("row", "id", "a", "b"), stored(classes, "linked-sets"), "copies", total, ["a", "b"])
    out = stored(out.select("row", "id", "label", "n_links"), "linked")
    heads = out.groupBy("label").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("h"), F.count("*").alias("m"))
    done = by_label(out, stored(heads.select("label", "class_id", "m", F.col("h.row").alias("head")), "heads"), "m", total, ["label"])
    return done.select(F.col("id").alias(id_col), "class_id", "n_links", (F.col("row") == F.col("head")).alias("kept"))


def op8_near_join(spark, sf_dir: str) -> DataFrame:
    """Class and links of every document. Nulls, empties and repeats: as near_duplicates says."""
    return near_duplicates(table(spark, sf_dir, "documents"))
