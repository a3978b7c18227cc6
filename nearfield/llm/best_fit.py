"""Best-fit packing: a grouping genetic algorithm on islands, whose elites migrate."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import pieces, stored, table, trim

#: Documents that are packed with one another; what a row of an island holds is bounded by it.
PART_ITEMS = 4096
#: Islands of a part, members of an island's population, children of an epoch, and epochs at most.
ISLANDS, MEMBERS, CHILDREN, EPOCHS = 3, 4, 16, 4
#: A part's emptiest bins, with at most this share of its documents, are opened and packed again with those of others.
POOLED = 1 / 8
#: A longer text is encoded in parts of about so many characters.
LONG_TEXT = 1 << 20


def byte_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a .json tokenizer of the tokenizers library, special strings as its default has them.

    A byte-level vocabulary whose ids are in the order of its merges is handed to tiktoken, which then finds the same
    ids, some four times as fast. Other files, and texts that its patterns give up on, go to tokenizers itself.
    """
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    slow = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, pre, vocab = j["model"], j["pre_tokenizer"] or {}, j["model"].get("vocab")
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or odd or j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return slow
    # the printable bytes stand for themselves, the others for the code points from 256 on, in order
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merged)) or len(merged) + 256 != len(set(vocab) - set(special)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in j["added_tokens"]):
        return slow
    import tiktoken

    ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:
            return slow(text)
        except BaseException as e:  # a panic of its pattern matcher, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def piece_table(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(row, id, n_tokens, full, crcs[, ids]): every document's tokens with end_id behind them, and its pieces.

    The first piece is what is left over when as many pieces of capacity as possible are cut from the end; crcs has each
    piece's checksum. full numbers the pieces of full length over all documents, with gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        from nearfield.llm.token_counts import json_parts

        path = tokenizer
        if not os.path.dirname(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        if path not in _encoders:
            _encoders[path] = byte_encoder(path)
        encode, number = _encoders[path], TaskContext.get().partitionId() << 33
        end = np.array([end_id], np.uint32)
        for batch in pieces(batches, 2):
            n, full, crcs, ids = [], [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                parts = [encode(p) for p in (json_parts(text, LONG_TEXT) if len(text) > LONG_TEXT else [text])]
                own = np.concatenate([*parts, end]).astype("<u4", copy=False)
                head = (len(own) - 1) % capacity + 1
                n.append(len(own))
                full.append(number)
                number += len(own) // capacity
                cuts = [0, *range(head, len(own) + 1, capacity)]
                crcs.append([zlib.crc32(own[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
                if with_ids:
                    ids.append(own.astype(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(full, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "full", "crcs", "ids"][: len(columns)])
        trim()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, n_tokens long, full long, crcs array<long>" + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, order: np.ndarray, place: np.ndarray, load: list[int], capacity: int) -> None:
    """Puts the items of order, one after another, each into the fullest bin with room; place and load are written to."""
    room: dict[int, list[int]] = {}
    mask = 0  # the amounts of room that some bin has
    for b, x in enumerate(load):
        if x < capacity:
            room.setdefault(capacity - x, []).append(b)
            mask |= 1 << (capacity - x)
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if m := mask >> s:
            r = s + (m & -m).bit_length() - 1
            bins = room[r]
            b = bins.pop()
            if not bins:
                mask ^= 1 << r
        else:
            b, r = len(load), capacity
            load.append(0)
        place[i] = b
        load[b] += s
        if r := r - s:
            mask |= 1 << r
            room.setdefault(r, []).append(b)


def fitness(sizes: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """Fewer bins are fitter; of as many, those whose fill is less even."""
    load = np.bincount(place, sizes)
    return -len(load), int((load * load).sum())


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A bound that no packing is below: for each small size a, items over capacity - a are alone, larger halves share
    with none of their kind, and what those of a or more don't fit beside these fills bins of its own."""
    count = np.bincount(sizes, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, a = capacity // 2, np.arange(1, capacity // 2 + 1)
    alone = n[capacity] - n[capacity - a]
    large, large_sum = n[capacity - a] - n[half], total[capacity - a] - total[half]
    rest = total[half] - total[a - 1] - (large * capacity - large_sum)
    return int((alone + large + np.maximum(0, -(-rest // capacity))).max(initial=-(-int(sizes.sum()) // capacity)))


def compact(place: np.ndarray) -> np.ndarray:
    """Bins numbered from 0 without gaps."""
    return np.unique(place, return_inverse=True)[1].astype(np.int32)


def noisy_order(sizes: np.ndarray, items: np.ndarray, rng: np.random.Generator, noise: float) -> np.ndarray:
    """Items by falling size, sizes blurred by a share of themselves; ties by number."""
    return items[np.argsort(-sizes[items] * (1 + noise * rng.random(len(items))), kind="stable")]


def cross(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child: whole well-filled bins of other are put in, bins of one that share a document with them are taken out
    (their copies go, the rest of them is displaced), and what is displaced, with a few of the emptiest bins, is fitted
    in again."""
    load = np.bincount(other, sizes)
    chosen = (load >= np.quantile(load, 0.25)) & (rng.random(len(load)) < rng.uniform(0.1, 0.5))
    put = chosen[other]
    out = np.zeros(one.max() + 1, bool)
    out[one[put]] = True
    own = np.bincount(one, sizes, len(out))
    spare = np.flatnonzero(~out & (own < capacity))
    out[spare[np.argsort(own[spare], kind="stable")[: 1 + len(spare) // 32]]] = True
    loose = out[one] & ~put
    child = np.where(put, other + len(out), one)
    child[~loose] = compact(child[~loose])
    held = np.bincount(child[~loose], sizes[~loose]).astype(int).tolist()
    best_fit(sizes, noisy_order(sizes, np.flatnonzero(loose), rng, rng.choice([0.0, 0.1, 0.5])), child, held, capacity)
    return child


def evolve(sizes: np.ndarray, members: list[np.ndarray], rng: np.random.Generator, capacity: int, children: int = CHILDREN, keep: int = MEMBERS) -> list[np.ndarray]:
    """An epoch of an island: children by pairs of members, the fittest members stay, the first is the elite. It ends
    early where the elite has as few bins as least_bins."""
    least = least_bins(sizes, capacity)
    ranked = sorted(((fitness(sizes, m), i, m) for i, m in enumerate(members)), key=lambda x: (x[0], -x[1]), reverse=True)[:keep]
    for born in range(children):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = cross(sizes, ranked[a][2], ranked[b][2], rng, capacity)
        fit = fitness(sizes, child)
        if all(fit != r[0] for r in ranked):
            ranked = sorted([*ranked, (fit, len(members) + born, child)], key=lambda x: (x[0], -x[1]), reverse=True)[:keep]
    return [m for _, _, m in ranked]


def first_members(sizes: np.ndarray, rng: np.random.Generator, capacity: int, n: int = MEMBERS) -> list[np.ndarray]:
    """Best fits in falling order of sizes, blurred more from member to member."""
    out = []
    for i in range(n):
        place = np.zeros(len(sizes), np.int32)
        best_fit(sizes, noisy_order(sizes, np.arange(len(sizes)), rng, (0.0, 0.1, 0.3, 1.0)[i % 4]), place, [], capacity)
        out.append(place)
    return out


_ISLAND = "part long, island int, rows array<long>, sizes array<int>, members array<array<int>>, bins int, least int"


def _epoch(capacity: int, seed: int, epoch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                sizes = np.asarray(r.sizes, np.int64)
                rng = np.random.default_rng([seed, epoch, r.part, r.island])
                members = [np.asarray(m, np.int32) for m in r.members] if len(r.members) else first_members(sizes, rng, capacity)
                members = evolve(sizes, members, rng, capacity)
                out.append((r.part, r.island, r.rows, r.sizes, members, int(members[0].max()) + 1, least_bins(sizes, capacity)))
            yield pd.DataFrame(out, columns=["part", "island", "rows", "sizes", "members", "bins", "least"])

    return run


def _settle(round_: int, capacity: int, last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each document's bin and place in it; of parts that aren't the last, the emptiest bins stay open."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                sizes, place = np.asarray(r.sizes, np.int64), np.asarray(r.best, np.int64)
                order = np.argsort(place, kind="stable")
                ends = np.cumsum(sizes[order])
                firsts = np.flatnonzero(np.diff(place[order], prepend=-1))
                offset = np.empty(len(sizes), np.int64)
                offset[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[firsts], np.diff([*firsts, len(sizes)]))
                load, held = np.bincount(place, sizes), np.bincount(place)
                emptiest = np.argsort(load, kind="stable")
                opened = np.zeros(len(load), bool)
                if not last:
                    opened[emptiest[(np.cumsum(held[emptiest]) <= POOLED * len(sizes)) & (load[emptiest] < capacity)]] = True
                yield pd.DataFrame({"row": r.rows, "size": sizes.astype(np.int32), "sequence": (round_ << 58) + (r.part << 22) + place, "offset": offset, "settled": ~opened[place]})

    return run


def pack(items: DataFrame, capacity: int, part_items: int = PART_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 11) -> DataFrame:
    """items (row, size) with sequence and offset: sizes from 1 to capacity, packed into few sequences of capacity.

    Items are dealt to parts of about part_items by a seeded hash of their row. Each part lives on several islands, a
    row each with its items and its own population of packings; epochs of evolve() run on all islands side by side.
    Between epochs the elite of each island migrates to the part's next island. Parts whose elite has as few bins as
    least_bins() allows are done; the last epoch ends at epochs, or when all are. The fittest elite of a part is taken.
    Its emptiest bins, with a few of its items, are opened: those of all parts are dealt anew to parts, round by round,
    until one part is left, so a part's rest costs no sequence.

    Every island's row, migration and round is written to the shared folder, so a lost executor costs its tasks only.
    Counts go to the driver, nothing else. Sizes out of range are an error; no items give no rows; rows are unique.
    """
    spark = items.sparkSession
    items = items.select("row", F.assert_true((F.col("size") >= 1) & (F.col("size") <= capacity)).isNull().alias("fits"), F.col("size").cast("int").alias("size")).where("fits").select("row", "size")
    done: list[DataFrame] = []
    for round_ in range(16):
        n = items.count()
        parts = max(1, -(-n // part_items)) if n > 2 * part_items else 1
        one = F.sort_array(F.collect_list(F.struct("row", "size")))
        dealt = items.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + round_), F.col("row")), F.lit(parts))).groupBy("part").agg(one.alias("x"))
        state = dealt.select("part", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.row").alias("rows"), F.col("x.size").alias("sizes"), F.array().cast("array<array<int>>").alias("members"))
        state = stored(state.repartition("part", "island").mapInPandas(_epoch(capacity, seed + round_, 0), _ISLAND), "islands")
        ended: list[DataFrame] = []
        for epoch in range(1, epochs + 1):
            best = state.groupBy("part").agg((F.min("bins") > F.max("least")).alias("open"))
            open_ = best.where("open")
            if epoch == epochs or open_.isEmpty():
                ended.append(state)
                break
            ended.append(state.join(open_, "part", "left_anti"))
            state = state.join(open_.select("part"), "part")
            elites = state.select("part", ((F.col("island") + 1) % islands).alias("island"), F.col("members")[0].alias("elite"))
            state = state.join(elites, ["part", "island"]).select("part", "island", "rows", "sizes", F.array_append("members", F.col("elite")).alias("members"))
            state = stored(state.mapInPandas(_epoch(capacity, seed + round_, epoch), _ISLAND), "islands")
        lives = ended[0]
        for e in ended[1:]:
            lives = lives.unionByName(e)
        first = F.min_by(F.struct("rows", "sizes", F.col("members")[0].alias("best")), F.struct("bins", "island"))
        last = parts == 1 or round_ == 15
        packed = lives.groupBy("part").agg(first.alias("x")).select("part", "x.*")
        packed = stored(packed.mapInPandas(_settle(round_, capacity, last), "row long, size int, sequence long, offset long, settled boolean"), "packed")
        done.append(packed.where("settled").select("row", "sequence", "offset"))
        if last:
            break
        items = packed.where("not settled").select("row", "size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **how: int) -> DataFrame:
    """Documents as pieces in sequences of at most capacity tokens: id_col, piece, start, length, ids_crc32, sequence_id,
    offset, and ids if asked for.

    A document is its ids and end_id. Only longer ones are cut: all their pieces but the first have capacity tokens and
    a sequence each, so the first, or the whole of shorter ones, is what pack() places. Args beyond: those of pack().

    Texts are read once; what is shuffled after that has a few numbers a document (and its ids with with_ids). A row for
    each piece: null and empty texts are one token; a null id stays null; rows that repeat an id are documents each; an
    empty table gives no rows; other columns are not read. Texts of any length are whole in one row's task.
    """
    held = stored(piece_table(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    head = (F.col("n_tokens") - 1) % capacity + 1
    placed = pack(held.select("row", head.alias("size")), capacity, **how)
    rows = held.withColumn("head", head).join(placed, "row")
    rows = rows.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    whole = F.col("piece") > 0
    start = F.when(whole, F.col("head") + (F.col("piece") - 1) * capacity).otherwise(0)
    length = F.when(whole, F.lit(capacity)).otherwise(F.col("head"))
    sequence = F.when(whole, -(F.col("full") + F.col("piece"))).otherwise(F.col("sequence"))
    out = rows.select(F.col("id").alias(id_col), "piece", start.cast("long").alias("start"), length.cast("long").alias("length"), "ids_crc32", sequence.alias("sequence_id"), F.when(whole, 0).otherwise(F.col("offset")).cast("long").alias("offset"), *(["ids"] if with_ids else []))
    return out.withColumn("ids", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))) if with_ids else out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences of pack_documents(with_ids=True), each one's pieces in order of offset."""
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(whole.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"))


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places. Null texts are one token; more in pack_documents."""
    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
