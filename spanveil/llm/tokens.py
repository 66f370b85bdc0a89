"""Token counts by a map-side two-tier lookup.

A text is cut at ASCII white space, which none of the tokenizer's own pre-tokens
crosses, and each piece's token count is looked up: first in a broadcast table of
frequent pieces, then in the worker's cache, which encodes what it misses with the
library. Nothing is shuffled. The frequent pieces are counted in a task over the first
``sample_docs`` documents; that choice changes the speed only, never a count. A text that
may hold one of the tokenizer's special strings goes to the library whole, as do all texts
if the tokenizer's normaliser or pre-tokenizer is another than the one whose cuts are
known here (``NORMALISER``, ``PRE_TOKENIZER``).

Defined results: a null or empty text has 0 bytes and 0 tokens; rows that repeat count
each; long texts are never cut; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, FREQUENT = 512, 65_536
#: Entries of a worker's caches; beyond that they start anew.
MOST_CACHED, MOST_PARTS = 1_200_000, 1_200_000
#: Punctuation that is cut off a piece's end.
TAIL = b".,!?;:#$%&*|"
#: Words of a run of documents that are looked up together.
RUN_WORDS = 100_000
#: Pieces that the library encodes at once: it takes about a KB for each until their values are read.
MOST_AT_ONCE = 2048

#: Longest piece that counts as frequent, in bytes.
FREQUENT_BYTES = 64
# How a tokenizer must read a text for its pieces to be encoded apart.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, and its special strings; None in their place if texts must not be cut."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0]
        known = made.get("normalizer") == NORMALISER and first == PRE_TOKENIZER
        _tokenizers[path] = t, [x.content.encode() for x in t.get_added_tokens_decoder().values()] if known else None
    return _tokenizers[path]


def runs(batches: Iterator[pa.RecordBatch], marks: list[bytes] | None) -> Iterator[tuple[list, list, list]]:
    """(ids, texts as bytes, words or None where the text holds a special string or is not cut), a bounded number of words each."""
    ids, texts, words, n = [], [], [], 0
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        for key, text in zip(batch.column(0), column):
            raw = text.as_py() or b""
            ids.append(key.as_py())
            texts.append(raw)
            words.append(None if marks is None or any(m in raw for m in marks) else raw.split())
            n += len(raw)
            if n > 6 * RUN_WORDS:
                yield ids, texts, words
                ids, texts, words, n = [], [], [], 0
    if ids:
        yield ids, texts, words


class Pieces:
    """A worker's cache: piece -> value, made of the values of its core and its tail.

    Where ASCII punctuation follows an ASCII letter the tokenizer always cuts, and it
    lowers A-Z itself; so ``Word,`` and ``word.`` share the core ``word``, and only cores
    and tails are encoded. Values add up (lengths, or ids as bytes).
    """

    def __init__(self, tok, value):
        self.tok, self.value = tok, value
        self.words: dict = {}
        self.parts: dict = {}

    def learn(self, words: list) -> dict:
        """Makes sure that all pieces of these lists are cached."""
        pieces = set().union(*[w for w in words if w])
        known, parts = self.words, self.parts
        missing = [w for w in pieces if w not in known]
        if len(known) + len(missing) > MOST_CACHED:
            known.clear()
            missing = list(pieces)
        cuts = [_cut(w) for w in missing]
        asked = {p for cut in cuts for p in cut}
        new = [p for p in asked if p not in parts]
        if len(parts) + len(new) > MOST_PARTS:
            parts.clear()
            new = list(asked)
        for i in range(0, len(new), MOST_AT_ONCE):
            some = new[i : i + MOST_AT_ONCE]
            parts.update(zip(some, map(self.value, self.tok.encode_batch([p.decode() for p in some], add_special_tokens=False))))
        for w, cut in zip(missing, cuts):
            known[w] = parts[cut[0]] if len(cut) == 1 else parts[cut[0]] + parts[cut[1]]
        return known


def _cut(piece: bytes) -> tuple[bytes, ...]:
    # lowered, it could become a special string; combining marks may join a letter before it is lowered
    if b"<" in piece or b"\xcc" in piece or b"\xcd" in piece:
        return (piece,)
    low = piece.lower()
    core = low.rstrip(TAIL)
    return (core, low[len(core) :]) if core and core != low and 97 <= core[-1] <= 122 else (low,)


_lengths: dict = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit (more tokens than limit)."""
    spark = docs.sparkSession
    tok, marks = tokenizer(tokenizer_path)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(w for w in (text.as_py() or b"").split() if len(w) <= FREQUENT_BYTES)
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:frequent]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary())], ["piece"])

    # at most so many pieces of bounded length, of one task
    top = [bytes(r[0]) for r in docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).limit(sample_docs).coalesce(1).mapInArrow(sampled, "piece binary").collect()] if marks is not None else []
    table = {w: len(e) for w, e in zip(top, tok.encode_batch([w.decode() for w in top], add_special_tokens=False))}
    shared = spark.sparkContext.broadcast((b" ".join(table), bytes(min(v, 255) for v in table.values())))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, marks = tokenizer(tokenizer_path)
        names, sizes = shared.value
        first = {w: n for w, n in zip(names.split(), sizes) if n < 255}
        cache = _lengths.setdefault(tokenizer_path, Pieces(tok, len))
        for ids, texts, words in runs(batches, marks):
            rest = [[w for w in ws if w not in first] if ws else ws for ws in words]
            known = cache.learn(rest)
            counts = []
            for text, ws, rs in zip(texts, words, rest):
                if ws is None:
                    counts.append(len(tok.encode(text.decode(), add_special_tokens=False)))
                else:
                    counts.append(sum(map(first.get, ws, [0] * len(ws))) + sum(map(known.__getitem__, rs)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = pa.int64()
    return rows.mapInArrow(counted, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
