"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand side by side inside no token of the vocabulary can never be merged, nor
can anything across them. Words are cut there; the fragments are encoded independently, each by its own
merges, and kept, and their ids are joined. The vocabulary is a file in the format of the tokenizers library:
NFC, white space to one space, lower case, words by a pattern, bytes as characters, a mark on word ends.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table, text_chunks, with_field

#: Characters that str.split() takes for white space and the pattern's \s does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Characters of a word or fragment whose ids are kept for the next time.
LONG = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """Results of a function; of two generations of ``limit`` results each the older one goes when the newer is full.

    Results of keys of over LONG characters are not kept.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class WordBPE:
    """Vocabulary, merges and cuts of one tokenizer file."""

    def __init__(self, path: str, limit: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.characters = byte_characters()
        pairs = {p for t in self.ids for s in [self._symbols_of(t)] for p in zip(s, s[1:], strict=False)}
        # Neighbours inside some token: those at its end, with the mark of word ends taken off, and all others.
        self.inside_end = {a + b.removesuffix(self.end) for a, b in pairs if self.end and len(b) > 1}
        self.inside = {a + b for a, b in pairs if len(b) == 1}
        self.fragments, self.chunks = Recent(self._fragment, limit), Recent(self._chunk, limit)

    def _symbols_of(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def cut(self, word: str) -> list[str]:
        """Fragments of a word at its forced boundaries; the last one bears the mark of word ends."""
        plain = word.isascii() and word.isprintable()
        text = word if plain else "".join([self.characters[b] for b in word.encode("utf-8")])
        inside, last = self.inside, len(text) - 1
        at = [i for i in range(1, last) if text[i - 1 : i + 1] not in inside]
        if last and text[last - 1 :] not in (self.inside_end if self.end else inside):
            at.append(last)
        return [text[i:j] for i, j in zip([0, *at], at, strict=False)] + [text[at[-1] if at else 0 :] + self.end]

    def merged(self, fragment: str) -> list[int]:
        """Ids of a fragment: the lowest-ranked pair is merged, leftmost first, until none is left.

        Pairs wait in a heap over a linked list of parts, so that long runs of letters take no quadratic time.
        """
        parts: list[str | None] = list(self._symbols_of(fragment))
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j == n or parts[j] != right:
                continue  # one of the two was merged since
            parts[i], parts[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := (parts[i], parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            h = before[i]
            if h >= 0 and (pair := (parts[h], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], h, *pair))
        return [self.ids[p] for p in parts if p is not None and p in self.ids]

    def _fragment(self, fragment: str) -> bytes:
        ids = self.merged(fragment)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Little-endian ids of a stretch without white space."""
        # Lower case is taken letter by letter, so a capital sigma is never a final one.
        low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return b"".join([self.fragments[f] for w in self.words.findall(low) for f in self.cut(w)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of added tokens give their ids."""
        out, at = [], 0
        for m in self.added_pattern.finditer(text) if self.added and "<" in text else ():
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        chunks = [c for c in _WHITE.split(text) if c] if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space, as a tokenizer file without a decoder asks."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.cache
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "input_ids") -> DataFrame:
    """``docs`` with the array<int> ``to`` of token ids of each whole text.

    Null and empty texts, and texts of white space, have no ids; an empty table gives an empty one. Repeated rows
    are encoded alike. Other columns are carried unchanged, whatever their names; one named ``to`` is replaced.
    A word of any length is one sequence and takes n log n time; what a task keeps of words is bounded.
    """
    kept, schema = with_field(docs, to, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for chunk in text_chunks(batches, text):
            parts = [bpe.encode(t) if t else b"" for t in chunk.column(text).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.ListArray.from_arrays(pa.array(ends), ids)], [*chunk.schema.names, to])

    return map_arrow(kept, run, schema)


def decode(df: DataFrame, path: str, ids: str = "input_ids", to: str = "decoded") -> DataFrame:
    """``df`` with the string ``to`` decoded from the ids of each row; null ids decode to an empty string.

    Other columns are carried unchanged; one named ``to`` is replaced.
    """
    kept, schema = with_field(df, to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [bpe.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, to])

    return map_arrow(kept, run, schema)


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them, by the contract of this query."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = [(len(ids := row.values.to_numpy().astype("<u4")), _hex(ids.tobytes()), _hex(bpe.decode(ids.tolist()).encode())) for row in batch.column("input_ids")]
            n, ids_hex, text_hex = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "input_ids")
    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
