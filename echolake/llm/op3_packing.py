"""Packing token sequences: shortest-pack-first over the length histogram.

Texts are tokenized in tasks and cut into pieces of at most ``capacity`` ids.
The histogram of piece lengths (``capacity`` rows at most) goes to the driver,
where lengths are placed longest first, each into the packs that are shortest
so far, updating the counts of packing patterns.  The patterns are joined back
to the pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.groups import own_columns
from echolake.plans.ranking import exact_rank
from echolake.plans.shared import materialize

CAPACITY = 2048
END_ID = 1
#: Words kept with their ids in a Python worker; it is emptied when full.
CACHE_WORDS = 1_000_000
_CACHE_CHARS = 48
_CLOSING = ".,;:!?"
#: Below this, lower case and composed form are the same letter by letter.
_PLAIN = "\u0250"
#: How byte-level BPE writes the bytes that aren't printable.
_BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}


def _plain(text: str) -> str:
    """A text with the same ids whose words repeat more often: in lower case."""
    try:
        narrow = text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        narrow = False
    if narrow and "<|" not in text:
        text = text.lower()
    return text.replace("\n", " ")


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins what stands on both sides
    of it, so a text's ids are those of its words in turn, and frequent words
    are encoded once.  A word of letters before closing punctuation is encoded
    apart from it and in lower case, as the tokenizer would, by its model alone.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._model = self._tokenizer.model
        self._raw = [k.to_bytes(4, "little") for k in range(max(self._tokenizer.get_vocab().values()) + 1)]
        self._known: dict[str, bytes] = {"": b""}

    def _singly(self, words: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: Iterable[str]) -> list[bytes]:
        """Words of letters in lower case: what the tokenizer does before its model leaves them whole."""
        raw, tokenize = self._raw, self._model.tokenize
        shown = (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS) for w in words)
        return [b"".join([raw[t.id] for t in tokenize(w)]) for w in shown]

    def _learn(self, words: list[str]) -> None:
        known = self._known
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        letters, parts, other = set(), [], []
        for w in words:
            stem = w if w.isalpha() else w.rstrip(_CLOSING)
            if len(w) <= _CACHE_CHARS and stem.isalpha() and (stem.isascii() or (max(stem) < _PLAIN and "\u0130" not in stem)):
                low = stem.lower()
                if low not in known:
                    letters.add(low)
                if low != w:
                    parts.append((w, low, w[len(stem) :]))
            else:
                other.append(w)
        known.update(zip(letters, self._letters(letters), strict=True))
        tails = list({t for _, _, t in parts if t not in known})
        known.update(zip(tails, self._singly(tails), strict=True))
        known.update([(w, known[s] + known[t]) for w, s, t in parts])
        for k in range(0, len(other), 4096):
            known.update(zip(other[k : k + 4096], self._singly(other[k : k + 4096]), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [_plain(t).split(" ") if t else [] for t in texts]
        words = set().union(*split)
        new = words.difference(self._known)
        if len(self._known) + len(new) > CACHE_WORDS:
            new = words
        self._learn(list(new))
        ids = self._known.__getitem__
        out = [b"".join(map(ids, own)) for own in split]
        for w in new:
            if len(w) > _CACHE_CHARS:
                del self._known[w]
        return out


_encoders: dict[int, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens) for each piece of each text.

    A text's ids end in ``END_ID``; a null or empty text has that one only.
    With ``with_ids``, the ids follow as an array.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        encode = _encoders.setdefault(zlib.crc32(shared.value.encode()), None) or WordEncoder(shared.value)
        _encoders[zlib.crc32(shared.value.encode())] = encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in (b.slice(k, 256) for b in batches for k in range(0, max(1, b.num_rows), 256)):
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(found + end)
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    row = (doc_id, at, len(piece) // 4, zlib.crc32(piece), n)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
            cols = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Pattern:
    """``count`` packs that hold the same lengths: items are (length, how many, offset)."""

    count: int
    used: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def with_item(self, count: int, length: int, many: int) -> Pattern:
        return Pattern(count, self.used + length * many, [*self.items, (length, many, self.used)])


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Packing patterns for counts by length; every length is from 1 to ``capacity``; no lengths give none."""
    packs: dict[int, list[Pattern]] = {}  # by free space
    free: list[int] = []  # the keys of packs, ascending

    def put(p: Pattern) -> None:
        room = capacity - p.used
        if room not in packs:
            packs[room] = []
            free.insert(int(np.searchsorted(free, room)), room)
        packs[room].append(p)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = free[-1] if free else 0
            if room < length:
                many = capacity // length
                for count, k in ((left // many, many), (1, left % many)):
                    if count and k:
                        put(Pattern(count, 0).with_item(count, length, k))
                break
            group = packs[room].pop()
            if not packs[room]:
                del packs[room]
                free.pop()
            level = free[-1] if free else 0  # fill down to the next shortest packs
            many = max(1, min(room // length, (room - level) // length))
            if left < group.count * many:
                many = max(1, left // group.count)
            count = min(group.count, left // many)
            if count < group.count:
                put(Pattern(group.count - count, group.used, group.items))
            put(group.with_item(count, length, many))
            left -= count * many
    return [p for room in free for p in packs[room]]


def _slots(patterns: list[Pattern]) -> dict[int, dict[str, np.ndarray]]:
    """By length: where the ranks of its pieces go."""
    out: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    base = 0
    for p in patterns:
        for length, many, offset in p.items:
            at = taken.get(length, 0)
            out.setdefault(length, []).append((at, base, many, offset))
            taken[length] = at + p.count * many
        base += p.count
    names = ("rank", "base", "many", "offset")
    return {n: dict(zip(names, np.array(rows, np.int64).T, strict=True)) for n, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 3) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences have no gaps.

    Pieces have columns doc_id, start, length (1 to ``capacity``), ids_crc32; other
    columns stay as they are, but ``sequence_id`` or ``offset`` raise an error.
    A null doc_id is a value like others, an empty table gives an empty one.
    Read more than once, so materialize them first.  Pieces equal in all of
    these may swap places.
    """
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    histogram = {r["length"]: r["n"] for r in found}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(shortest_pack_first(histogram, capacity)))
    hashed = F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed))
    ranked = exact_rank(pieces, ["length"], hashed, ["doc_id", "start", "ids_crc32"], "__el_rank", sum(histogram.values()))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            rank, length = f["__el_rank"].to_numpy(), f["length"].to_numpy()
            for n in np.unique(length):
                here, s = np.flatnonzero(length == n), slots.value[int(n)]
                k = np.searchsorted(s["rank"], rank[here], "right") - 1
                turn = rank[here] - s["rank"][k]
                seq[here] = s["base"][k] + turn // s["many"][k]
                off[here] = s["offset"][k] + n * (turn % s["many"][k])
            yield f.drop(columns="__el_rank").assign(sequence_id=seq, offset=off)

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*own_columns(pieces), "__el_rank").mapInPandas(place, f"{cols}, sequence_id long, offset long")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file at ``path``, by default the public word-level BPE of 49k ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, packed into sequences of at most 2048."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = materialize(token_pieces(docs, tokenizer_json()), "pieces")
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
