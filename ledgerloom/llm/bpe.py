"""Byte-level BPE by forced-boundary splitting.

Byte pairs that never occur inside any vocabulary token mark certain cuts: no token can span them. Of those, the cuts
before an ASCII white-space byte are used, because there the pre-tokenizer's choices on either side don't depend on the
other side either. The fragments between cuts are encoded independently (each distinct one once, kept in a bounded
cache) and the ids are concatenated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

CACHE_FRAGMENTS = 200_000
CACHE_CHARS = 40
_PLAIN = re.compile(r"[\x00-\x7e\xa1-ɏ]*\Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class FragmentCodec:
    """Encodes and decodes whole texts exactly as the vocabulary's own tokenizer does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_padding()
        self.exact.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        vocabulary = {token: i for token, i in spec["model"]["vocab"].items()}
        added = {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocabulary.values(), *added]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for i, content in added.items():
            self.bytes_of[i] = content.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of])
        inside = np.zeros((256, 256), bool)  # pairs that some token holds
        for token in self.bytes_of:
            run = np.frombuffer(token, np.uint8)
            inside[run[:-1], run[1:]] = True
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        doubtful = inside & ~space[:, None]  # pairs that are no certain cut
        self.cut_before = [b for b in np.flatnonzero(space).tolist() if not doubtful[:128, b].any() and doubtful[:, b].sum() <= 8]
        # a character above ASCII is held together with the white space after it if its last byte is in such a pair (above U+FFFF: always)
        tails = {b & 0x3F for b in np.flatnonzero(doubtful[:, self.cut_before].any(axis=1)).tolist()}
        held = "".join(chr(c) for c in range(0x80, 0x10000) if c & 0x3F in tails and not 0xD800 <= c < 0xE000)
        held += "\U00010000-\U0010ffff" if held else ""
        cls = "".join(f"\\x{b:02x}" for b in self.cut_before)
        joined = f"(?:(?<=[{held}])[{cls}]+[^{cls}]*)*" if held else ""
        self.fragments = (re.compile(f"[{cls}]*[^{cls}]+{joined}|[{cls}]+") if cls else re.compile(r"(?s).+")).findall
        self.special = re.compile("|".join(map(re.escape, added.values()))) if added else None
        self.fast = self._ranked(spec, vocabulary, added)
        self.cache: dict[str, bytes] = {}

    def _ranked(self, spec: dict, vocabulary: dict[str, int], added: dict[int, str]):
        """The same vocabulary as ranks, where its merges are in the order of the ids; it is several times faster."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        single = all(len(self.bytes_of[i]) == 1 for i in range(256))
        if not single or order != list(range(256, 256 + len(order))) or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.bytes_of[i]: i for i in vocabulary.values() if i not in added}
        return tiktoken.Encoding("fragments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _learn(self, missing: Iterable[str], known: dict[str, bytes]) -> None:
        run, other = [], []
        lead = tuple(map(chr, self.cut_before))
        for f in missing:
            plain = self.fast and _PLAIN.match(f) and not (self.special and self.special.search(f))
            (run if plain and f[0] in lead and f[-1] not in lead else other).append((f, plain))
        for at in range(0, len(run), 20_000):
            part = [f for f, _ in run[at : at + 20_000]]
            ids = np.array(self.fast("".join(part)), dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.length_of[ids]), np.cumsum([len(f.encode()) for f in part]), "left") + 1
            raw, start = ids.tobytes(), 0
            for f, end in zip(part, (ends * 4).tolist()):
                known[f] = raw[start:end]
                start = end
        for f, plain in other:
            ids = self.fast(f) if plain else self.exact.encode(f, add_special_tokens=False).ids
            known[f] = np.array(ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_FRAGMENTS:
            self.cache.clear()
        out = []
        for at in range(0, len(texts), 64):
            cut = [self.fragments(t) for t in texts[at : at + 64]]
            missing = set().union(*cut).difference(self.cache)
            known, brief = self.cache, [f for f in missing if len(f) <= CACHE_CHARS]
            self._learn(brief, known)
            if len(brief) < len(missing):
                longer: dict[str, bytes] = {}
                self._learn((f for f in missing if len(f) > CACHE_CHARS), longer)
                out += [b"".join([known[f] if f in known else longer[f] for f in fs]) for fs in cut]
            else:
                out += [b"".join([known[f] for f in fs]) for fs in cut]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> FragmentCodec:
    """One per Python worker and vocabulary, with its cache."""
    return FragmentCodec(path)


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string: the text made again from the ids).

    A null text is an empty one: no ids, an empty string. Each row has its own output row, repeated ones too; other
    columns are ignored, whatever their names. Whole texts are encoded, whatever their length. An empty table gives an
    empty result.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids = tool.encode_batch([t or "" for t in batch.column(1)[at : at + 64].to_pylist()])
                arrays = [batch.column(0)[at : at + 64], pa.array(ids, pa.binary()), pa.array([tool.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])
        tool.cache.clear()  # a worker that goes on to other work keeps nothing of this

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
