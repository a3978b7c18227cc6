"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from nearfield.llm.common import byte_batches, pieces, table, texts_of

#: Entries that a worker keeps of the lengths of parts it has met.
CACHE_ENTRIES = 250_000

_PARTS = re.compile(rb" *[^ ]+(?: +\Z)?")
_BREAK = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def piece_parts(text: bytes) -> list[bytes]:
    """Parts of a text whose sentencepiece ids, put together, are those of the text.

    No piece holds the space mark behind another character, so a cut in front of a run of spaces is safe; the cut takes
    one space away, which the model's dummy prefix puts back. The literal space mark U+2581 is a space to the model.
    """
    text = text.replace(b"\xe2\x96\x81", b" ")
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ")
    parts = _PARTS.findall(text)
    return [p if i == 0 else p[1:] for i, p in enumerate(parts)] or [text]


def json_parts(text: str, longest: int) -> list[str]:
    """Parts of at most about `longest` characters, cut in front of a space between two letters.

    Pre-tokenizer patterns of byte-level and word BPE never match across such a place.
    """
    parts, start = [], 0
    while len(text) - start > longest:
        m = _BREAK.search(text, start + longest)
        if not m:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def piece_counter(path: str) -> Callable[[list[bytes]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known: dict[bytes, int] = {b"": 0}

    def count(texts: list[bytes]) -> list[int]:
        split = [piece_parts(t) for t in texts]
        if new := list(set().union(*split).difference(known)):
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                known[b""] = 0
                new = list(set().union(*split).difference(known))
            known.update(zip(new, map(len, model.encode([x.decode() for x in new], num_threads=1)), strict=True))
        return [sum(map(known.__getitem__, parts)) for parts in split]

    return count


def json_counter(path: str, longest: int) -> Callable[[list[bytes]], list[int]]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(texts: list[bytes]) -> list[int]:
        split = [json_parts(t.decode(), longest) for t in texts]
        sizes = iter([len(e) for e in tokenizer.encode_batch([p for s in split for p in s], add_special_tokens=False)])
        return [sum(next(sizes) for _ in s) for s in split]

    return count


_counters: dict[tuple, Callable[[list[bytes]], list[int]]] = {}


def counter(path: str, longest: int) -> Callable[[list[bytes]], list[int]]:
    """The counter of a tokenizer file, made once in each Python worker."""
    if (path, longest) not in _counters:
        _counters[path, longest] = piece_counter(path) if path.endswith(".model") else json_counter(path, longest)
    return _counters[path, longest]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 20, longest: int = 1 << 16) -> DataFrame:
    """Lengths in tokens of every whole text, without keeping ids.

    Args: tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file that every executor can open, or the
    bare name of one that the public_tokenizers package gives a path for. limit: over_limit is n_tokens > limit.
    batch_bytes: bytes of text encoded at a time. longest: a longer text is encoded in parts.

    Returns id_col, n_bytes, n_tokens, over_limit, a row for each row of docs: no shuffle, no row dropped. A null or
    empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated rows; other columns of docs
    are not read, whatever their names. A text of any length is counted whole.
    """

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        path = tokenizer
        if not os.path.dirname(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        count = counter(path, longest)
        for batch in pieces(batches, 1):
            texts = texts_of(batch.column(1))
            n = [c for a, b in byte_batches(texts, batch_bytes) for c in count(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. Null texts are empty; more in count_tokens."""
    return count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
