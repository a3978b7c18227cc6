"""Benchmark decontamination: Wu-Manber search for many word windows at once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import pieces, stored, table, texts_of

#: Words are runs of 0-9, a-z and everything beyond ASCII; A-Z are lower-cased, the rest becomes space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Search for word sequences. A block is a pair of words (a single word where some pattern has only one).

    For patterns whose shortest has m words, `shift` has for each block the least distance from its last place in any
    pattern's first m words to their end; an unknown block lets the search skip m - block + 1 words. At shift 0, the
    patterns whose first m words end in this block are the bucket; they are compared word by word, in full.
    """

    def __init__(self, patterns: list[tuple[bytes, ...]]) -> None:
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.shift: dict = {}
        self.buckets: dict = {}
        for k, p in enumerate(patterns):
            for j in range(m - b + 1):
                key = p[j] if b == 1 else p[j : j + 2]
                d = m - b - j
                if self.shift.get(key, d + 1) > d:
                    self.shift[key] = d
            self.buckets.setdefault(p[m - b] if b == 1 else p[m - 2 : m], []).append(k)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        n, m, get = len(words), self.m, self.shift.get
        i, most = m - 1, m - self.block + 1
        if self.block == 1:
            while i < n:
                w = words[i]
                d = get(w, most)
                if d:
                    i += d
                    continue
                s = i - m + 1
                for k in self.buckets[w]:
                    p = self.patterns[k]
                    if tuple(words[s : s + len(p)]) == p:
                        yield s, k
                i += 1
            return
        while i < n:
            pair = (words[i - 1], words[i])
            d = get(pair, most)
            if d:
                i += d
                continue
            s = i - m + 1
            for k in self.buckets[pair]:
                p = self.patterns[k]
                if tuple(words[s : s + len(p)]) == p:
                    yield s, k
            i += 1


class Windows:
    """The windows of some items, each window once with the items that have it, searched by length class.

    Items of fewer than `size` words are windows of their own length. They would shorten every skip, so they are
    searched apart from the full windows.
    """

    def __init__(self, items: list[tuple[object, bytes]], size: int) -> None:
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            w = words_of(text)
            for j in range(max(1, len(w) - size + 1) if w else 0):
                owners.setdefault(tuple(w[j : j + size]), set()).add(item)
        self.searches = []
        for part in ([p for p in owners if len(p) == size], [p for p in owners if len(p) < size]):
            if part:
                self.searches.append((WuManber(part), [(len(p), owners[p]) for p in part]))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) in words, merged and in order; the items with occurring windows."""
        spans, items = [], set()
        for search, about in self.searches:
            for s, k in search.find(words):
                length, own = about[k]
                spans.append((s, s + length))
                items |= own
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's items in blocks of bounded bytes, read one after another."""
    block, size = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        text = (r[1] or "").encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], text))
        size += len(text)
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Every occurrence of a benchmark window in every whole text.

    The benchmark is the stated query set: it is read in blocks of at most block_bytes (or one item), each block is
    broadcast and searched in one map over docs, so memory is bounded whatever the benchmark's size. No shuffle with
    one block; with more, the blocks' spans meet by row.

    Returns id_col, n_words, spans (array of [start, end) word positions, merged), items (sorted as strings), a row for
    each row of docs. Null and empty texts, and an empty benchmark, give no spans; items without words have no window;
    repeated rows give repeated rows; null item ids are left out of `items` but their words count as hit; other columns
    of docs are not read. With more than one block rows are numbered once a block, so docs has to be a table or a stable
    plan then.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text_col))

    def searcher(sent):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            windows = Windows(*sent.value)
            for batch in pieces(batches, 2):
                n, spans, items = [], [], []
                for t in texts_of(batch.column(2)):
                    words = words_of(t)
                    s, own = windows.hits(words)
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    items.append(sorted(str(x) for x in own if x is not None))
                pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))], ["row", "id", "n_words", "spans", "items"])

        return run

    schema = f"row long, id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    search = lambda block: source.mapInArrow(searcher(spark.sparkContext.broadcast((block, window))), schema)
    blocks = blocks_of(benchmark, item_col, item_text_col, block_bytes)
    out, more = search(next(blocks, [])), next(blocks, None)
    if more is not None:
        # several blocks: each is searched, written and let go, so the driver holds one at a time
        parts = [stored(out, "spans")]
        while more is not None:
            sent = spark.sparkContext.broadcast((more, window))
            parts.append(stored(source.mapInArrow(searcher(sent), schema).where("size(spans) > 0"), "spans"))
            sent.destroy()
            more = next(blocks, None)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

        def together(batches: Iterator) -> Iterator:
            import pyarrow as pa

            pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            for batch in batches:
                spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in own])] for own in batch.column(3).to_pylist()]
                items = [sorted(set(own)) for own in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))], batch.schema.names)

        out = rows.mapInArrow(together, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hits of all benchmark windows in every document. Nulls, empties and repeats: as find_contamination says."""
    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[j : j + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, j, dw.n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM (SELECT DISTINCT doc_id, j, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
