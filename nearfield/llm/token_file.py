"""Token-ID output: documents as range-coded blocks of ids in a table of segments, and back."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import discard, pieces, scratch, table, texts_of, trim
from nearfield.llm.range_coder import BLOCK_IDS, Prior, decode_blocks, encode_blocks, split_blocks

#: Entries that a worker keeps of the ids of words it has met.
CACHE_ENTRIES = 250_000
#: Ids that a worker codes at a time: some three thousand blocks side by side.
GROUP_IDS = 12 << 20
#: A segment is closed at so many ids; it holds whole documents, however long.
SEGMENT_IDS = 1 << 16


def _ends_plainly(word: bytes) -> bool:
    """Whether the last character is an ASCII letter or digit, or a Latin letter of two bytes that stays one in lower case."""
    last = word[-2:].decode(errors="ignore")[-1:]
    return word[-1:].isalnum() or ("\xc0" <= last < "\u0250" and last.isalpha() and last != "\u0130")


class MarkedWords:
    """Ids of texts by tiktoken, for a tokenizer of byte-level BPE that lower-cases texts, parts them into runs of letters, single
    digits, runs of other marks and English endings, drops white space and tells a word's last piece by "</w>".

    A word gets a space behind it, which stands for "</w>". The merges of a character with the space come before all
    others, so tiktoken begins with the pieces that BPE begins with, and takes the merge of the lowest rank as BPE does. It
    asks only whether the two pieces together are in the vocabulary; this is the same where every merge makes a piece of its
    own from earlier ones, and every piece's own bytes merge to it. Both are checked when a file is loaded.
    """

    #: Tokenizer files that this reads, but for vocabulary and merges.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    }
    #: Bytes of texts that are read here: ASCII but for control characters, and letters of U+00C0 to U+017F, which NFC leaves.
    ALLOWED = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
    #: ... but for the signs of multiplication and division, an I that becomes two characters, and special strings.
    OTHERS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"<|")
    #: ASCII in lower case, white space as spaces.
    LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
    #: 0 white space, 1 letters, 2 other marks, 3 digits.
    KINDS = bytes(0 if b == 32 else 3 if 48 <= b <= 57 else 1 if b >= 128 or 97 <= b <= 122 else 2 for b in range(256))
    #: A text with a longer word is left to the tokenizer, as tiktoken's merging is quadratic.
    LONGEST = 1000
    #: Bytes that tiktoken gets at a time.
    PART = 4 << 20

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or odd or model.get("end_of_word_suffix") != "</w>" or j["normalizer"] != self.NORMALIZER or j["pre_tokenizer"] != self.PRE_TOKENIZER:
            raise ValueError("another kind of tokenizer")
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        if any(not t.startswith("<|") for t in special) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in j["added_tokens"]):
            raise ValueError("other special strings")
        # the printable bytes stand for themselves, the others for the code points from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

        def marked(piece: str) -> bytes:
            word = piece.removesuffix("</w>")
            return bytes(map(byte_of.__getitem__, word)) + b" " * (word != piece)

        vocab = {marked(w): i for w, i in model["vocab"].items() if w not in special}
        merges = [tuple(map(marked, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        bytes_ = [bytes([b]) for b in range(256)]
        order = [b + b" " for b in bytes_] + [a + b for a, b in merges]
        place = {w: i for i, w in enumerate(order)} | {b: -1 for b in bytes_}
        whole = len(place) == len(order) + 256 and all(place.get(a, len(order)) < i and place.get(b, len(order)) < i for i, (a, b) in enumerate(merges, 256))
        # a space by itself is no piece here, but tiktoken asks for a rank of every byte
        order += bytes_
        if not whole or set(vocab) != set(order):
            raise ValueError("merges that don't make each piece once, from earlier ones")
        self.fast = tiktoken.Encoding("marked", pat_str=r"\S+ ", mergeable_ranks={w: i for i, w in enumerate(order)}, special_tokens={})
        rank = {w: i for i, w in enumerate(order)}
        # a piece in front of a byte that no merge has is merged from its bytes, not looked up
        if any(b"\0" in a + b for a, b in merges) or any(self.fast._encode_single_piece(w + b"\0") != [i, rank[b"\0"]] for w, i in rank.items() if b"\0" not in w):
            raise ValueError("pieces whose bytes don't merge to them")
        self.id_of, self.stop = np.array([vocab[w] for w in order], "<u2"), rank[b"\0 "]

    def can(self, text: bytes) -> bool:
        return not text.translate(None, self.ALLOWED) and not any(x in text for x in self.OTHERS)

    def __call__(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of each text, all of which it can; None where a word is too long."""
        # a zero byte is a word of its own, which stands behind each text
        joined = b" \0 ".join([b"", *[t.decode().lower().encode() if b"\xc4" in t or b"\xc5" in t else t for t in texts], b""]).translate(self.LOWER)
        x, kind = np.frombuffer(bytearray(joined), np.uint8), np.frombuffer(joined.translate(self.KINDS), np.uint8)
        at = np.flatnonzero(x == 0xC3) + 1
        x[at] += ((x[at] < 0x9F) * 32).astype(np.uint8)
        left, right = kind[:-1], kind[1:]
        cut = (left != right) | (left == 3)
        cut &= left != 0
        cut &= right != 0
        if b"'" in joined:
            self._endings(x, kind, cut)
        at = np.flatnonzero(cut) + 1
        apart, keep = np.full(len(x) + len(at), 32, np.uint8), np.ones(len(x) + len(at), bool)
        keep[at + np.arange(len(at))] = False
        apart[keep] = x
        spaces = np.flatnonzero(apart == 32)
        long = np.flatnonzero(np.diff(spaces) > self.LONGEST)
        if len(long):
            stops = np.flatnonzero(apart == 0)
            skip = set((np.searchsorted(stops, spaces[long]) - 1).tolist())
            rest = iter(self([t for i, t in enumerate(texts) if i not in skip]))
            return [None if i in skip else next(rest) for i in range(len(texts))]
        # its list of ids is there sooner than its buffer, for which it looks for special strings; a long text's list is large,
        # so texts are cut behind spaces
        found, start = array("I"), 0
        while start < len(apart):
            end = int(spaces[np.searchsorted(spaces, start + self.PART, side="right") - 1]) + 1
            found.extend(self.fast.encode_ordinary(apart[start:end].tobytes().decode()))
            start = end
        ranks = np.frombuffer(found, np.uint32)
        stops, raw = (np.flatnonzero(ranks == self.stop) * 2).tolist(), self.id_of.take(ranks).tobytes()
        return [raw[a + 2 : b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    @staticmethod
    def _endings(x: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> None:
        """'s, 't, 'm, 'd, 're, 've and 'll are words, if no other mark stands before them."""
        at = np.flatnonzero(x == 39)
        at = at[kind[at - 1] != 2]
        a, b = x[at + 1], x[at + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cut[at[one | two]] = False
        for end in (at[one] + 1, at[two] + 2):
            cut[end] = kind[end + 1] != 0


class WordIds:
    """Ids of a .json tokenizer whose pre-tokenizer parts words at white space, as little-endian u16 bytes.

    Each run between ASCII white space is encoded once and kept. Normalizers see runs apart from one another with the
    same result, as none of theirs reaches over white space. Special strings in a text are the tokenizer's tokens, as
    they are in its own encoding of the whole text: a text that could hold one is not lower-cased first.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.folds = self._same("Aa Zz The", "aa zz the")
        if not self._same("ab  cd\n\tab,\r cd\x0b\x0cab ", "ab cd ab, cd ab") or self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} doesn't part words at white space and drop it, or has over 65,536 ids")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # marks that are a word of their own behind a letter or digit, however many; apostrophes begin words, "<|" special strings
        self.marks = b".,#$%&*" if self._same("ab,$$ 12.#%&* c*", "ab ,$$ 12 .#%&* c *") else b""
        self.known: dict[bytes, bytes] = {}

    def _same(self, a: str, b: str) -> bool:
        return self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids

    def learn(self, runs: list[bytes]) -> None:
        known, words, rest, whole, tails = self.known, [], [], [], []
        for r in runs:
            core = r.rstrip(self.marks)
            # "word,$" is "word" and ",$"; the rest before it has to end in a letter or digit, or marks would join
            if len(core) < len(r) and b"<|" not in r and _ends_plainly(core):
                tails.append((r, core, r[len(core) :]))
            else:
                whole.append(r)
        for r in {x for _, *both in tails for x in both if x not in known}.union(whole):
            (words if r.isalpha() or not r.isascii() and r.decode().isalpha() else rest).append(r)
        for lo in range(0, len(words), 1000):
            self._letters(words[lo : lo + 1000])
        self._each(rest)
        for r, core, tail in tails:
            known[r] = known[core] + known[tail]

    def _each(self, runs: list[bytes]) -> None:
        for r, e in zip(runs, self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False), strict=True):
            self.known[r] = np.array(e.ids, dtype="<u2").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Words of letters alone, encoded as one text and cut where an id ends a word: a word has one such id. If there are
        more or fewer than words, each is encoded by itself."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u2")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._each(words)
            return
        raw, at = ids.tobytes(), 0
        for r, end in zip(words, ends, strict=True):
            self.known[r] = raw[2 * at : 2 * end]
            at = end

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [(t.lower() if self.folds and b"<|" not in t else t).split() for t in texts]
        known = self.known
        met = set().union(*split)
        new = met.difference(known)
        if new and len(known) + len(new) > CACHE_ENTRIES:
            # what this batch has, and so what is frequent, stays
            known = self.known = {r: known[r] for r in met.difference(new)}
        if new:
            self.learn(list(new))
        return [b"".join(map(known.__getitem__, s)) for s in split]


class TextIds:
    """Ids of texts by MarkedWords, where it knows the file and all characters of a text, and by WordIds otherwise."""

    def __init__(self, path: str) -> None:
        self.runs = WordIds(path)
        try:
            self.marked = MarkedWords(path)
        except (ValueError, KeyError):  # a file of another kind
            self.marked = None

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.marked:
            can = [i for i, t in enumerate(texts) if self.marked.can(t)]
            for i, x in zip(can, self.marked([texts[i] for i in can]), strict=True):
                out[i] = x
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self.runs([texts[i] for i in left]), strict=True):
            out[i] = x
        return out


_text_ids: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """A worker's own, which it keeps from task to task: loading and checking a file takes about a second."""
    if path not in _text_ids:
        _text_ids[path] = TextIds(path)
    return _text_ids[path]


def id_segments(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, segment, start, n_ids, ids, lengths, raw): docs in ascending id order as segments of token ids, raw.

    Documents are dealt by ranges of ids and sorted, so shards and the segments within them are in order; start is a
    segment's place in its shard.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        path = tokenizer
        if not os.path.dirname(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        encode = text_ids(path)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u2").tobytes()
        names: list = []
        parts: list[bytes] = []
        size = 0

        def pack():
            nonlocal number, start, size
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                    pa.array([names], pa.list_(ids_type)), pa.array([[len(x) // 2 for x in parts]], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary()),
                ],
                ["shard", "segment", "start", "n_ids", "ids", "lengths", "raw"],
            )
            number, start, size = number + 1, start + size, 0
            names.clear()
            parts.clear()
            return out

        ids_type = None
        for batch in pieces(batches, 1):
            ids_type = batch.column(0).type
            for name, x in zip(batch.column(0).to_pylist(), encode(texts_of(batch.column(1))), strict=True):
                x += end
                names.append(name)
                parts.append(x)
                size += len(x) // 2
                if size >= SEGMENT_IDS:
                    yield pack()
        if names:
            yield pack()
        encode.runs.known = {}
        del parts
        trim()

    # null ids first, then ascending; rows of one id stand by the hashes of their texts, so they can fall into many tasks;
    # equal rows by a seeded number, so that they can as well
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.rand(29).alias("r"))
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("r")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2], "text").select("id", "text")
    return dealt.mapInArrow(run, f"shard int, segment long, start long, n_ids long, ids array<{kind}>, lengths array<long>, raw binary")


def id_counts(segments: DataFrame) -> DataFrame:
    """(id, n) over all segments: at most 65,536 rows, and as many from a task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    return segments.select("raw").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def prior_of(head: DataFrame) -> Prior:
    counts = np.zeros(1 << 16, np.int64)
    for r in head.collect():
        counts[r["id"]] = r["n"]
    return Prior(counts)


def grouped(batches: Iterator, n_ids: int) -> Iterator[list]:
    """Rows of batches in groups of about GROUP_IDS ids, each a list of the columns' values."""
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            rows.append([c[i] for c in batch.columns])
            held += rows[-1][n_ids].as_py()
            if held >= GROUP_IDS:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def code_segments(segments: DataFrame, prior: Prior) -> DataFrame:
    """segments with their raw ids as coded blocks, one behind the other."""
    sent = segments.sparkSession.sparkContext.broadcast(prior)
    kind = segments.schema["ids"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in grouped(batches, 3):
            ids = [np.frombuffer(r[6].as_buffer(), dtype="<u2") for r in rows]
            blocks = [[x[i : i + BLOCK_IDS] for i in range(0, len(x), BLOCK_IDS)] for x in ids]
            coded = iter(encode_blocks([b for own in blocks for b in own], sent.value))
            data = [b"".join(next(coded) for _ in own) for own in blocks]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[j].as_py() for r in rows], rows[0][j].type) for j in range(6)], pa.array(data, pa.binary())], ["shard", "segment", "start", "n_ids", "ids", "lengths", "blocks"])
            del rows, ids, blocks, coded, data
        trim()

    return segments.select("shard", "segment", "start", "n_ids", "ids", "lengths", "raw").mapInArrow(run, f"shard int, segment long, start long, n_ids long, ids {kind}, lengths array<long>, blocks binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, each followed by end_id, and writes the file: `head`, the counts of its ids, from which
    order 0 starts in all blocks, and `segments`.

    Texts are tokenized once; their ids wait in the shared folder until all are counted. The files are Parquet, for its
    commit protocol and any file system; each segment's `blocks` are the coded blocks one behind the other (see
    range_coder), with no compression on top. Texts that are null or empty are the end id alone;
    documents of a null id come first; rows that repeat an id stand in the order of their texts' hashes, and may be dealt
    to many tasks; other columns aren't read; an empty table writes no segment. Texts of any length are encoded whole.
    Only tokenizers of at most 65,536 ids that part words at white space; others are an error.
    """
    raw = scratch(docs.sparkSession, "ids")
    id_segments(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(raw)
    segments = docs.sparkSession.read.parquet(raw)
    id_counts(segments).coalesce(1).write.parquet(f"{path}/head")
    code_segments(segments, prior_of(docs.sparkSession.read.parquet(f"{path}/head"))).write.option("compression", "none").parquet(f"{path}/segments")
    discard(docs.sparkSession, raw)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of the files; a checksum that differs is an error.

    A segment is decoded by itself, so nothing is shuffled. The driver holds the number of ids of each shard, which is a
    row for each task that wrote.
    """
    files = spark.read.parquet(f"{path}/segments")
    sent = spark.sparkContext.broadcast(prior_of(spark.read.parquet(f"{path}/head")))
    kind = files.schema["ids"].dataType.elementType.simpleString()
    shards = sorted((r[0], r[1]) for r in files.groupBy("shard").agg(F.sum("n_ids")).collect())
    before = spark.sparkContext.broadcast(dict(zip([s for s, _ in shards], accumulate([n for _, n in shards], initial=0), strict=False)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in grouped(batches, 5):
            id_type = rows[0][2].type.value_type
            rows = [[x.as_py() for x in r] for r in rows]
            blocks = [split_blocks(r[4]) for r in rows]
            ids = iter(decode_blocks([b for own in blocks for b in own], sent.value))
            out: tuple[list, ...] = ([], [], [], [], [])
            for (shard, start, names, lengths, _, _), own in zip(rows, blocks, strict=True):
                x = np.concatenate([next(ids) for _ in own]) if own else np.empty(0, "<u4")
                at, first, raw = 0, before.value[shard] + start, x.tobytes()
                for name, n in zip(names, lengths, strict=True):
                    out[0].append(name)
                    out[1].append(first + at)
                    out[2].append(n)
                    out[3].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    if with_ids:
                        out[4].append(x[at : at + n])
                    at += n
            cols = [pa.array(out[0], id_type), *[pa.array(c, pa.int64()) for c in out[1:4]]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[4], pa.list_(pa.int32()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])
            del rows, blocks, ids, out, cols
        trim()

    some = files.select("shard", "start", "ids", "lengths", "blocks", "n_ids")
    return some.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    """Every document as its token file gives it back. Null texts are the end id alone; more in write_tokens."""
    path = scratch(spark, "token-file")
    write_tokens(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json")
    return read_tokens(spark, path)
