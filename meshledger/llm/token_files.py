"""Token ids of whole documents in files of Re-Pair shards, written in ascending order of ids.

Documents are range-partitioned by id and sorted; each task encodes its range and cuts it into shards
of about SHARD_IDS ids (one document at least). Spark commits the shards as rows of Parquet files
(part, shard, documents, ids, payload), so lost tasks are written again and any file system serves.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshledger.llm import common, repair
from meshledger.session import scratch_path

END_ID, SHARD_IDS, KNOWN_WORDS = 2, 1 << 19, 400_000


class _Places(dict):
    """Numbers words in the order they come; new ones wait in ``new`` for their ids."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


#: Fixed value: the words of a tokenizer whose texts may be encoded word by word.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: A capital before one of these bytes may compose with a mark, which must happen before it is lower-cased;
#: letters of Latin-1 and Latin Extended-A and -B (C2 to C8) are no marks and stand between it and any.
MAY_COMPOSE = np.r_[np.zeros(0x80, bool), np.ones(0x80, bool)]
MAY_COMPOSE[0xC2:0xC9] = False
ALNUM = common.byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
MARK = common.byte_class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Lower-case letters of ASCII and Latin-1 only: words that no normaliser of `goes_by_words` changes, and no pattern cuts.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Bytes of a word that its key holds; the key's last byte is its length.
KEY_BYTES, SLOT_BITS = 15, 21
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def goes_by_words(definition: str) -> bool:
    """Whether a tokenizer gives a text the ids of its words (between white space), one after the other.

    That is known of tokenizers that normalise by nothing but NFC, lower case and one space for white
    space, keep WORD_PATTERN only, mark the end of a word, and have `<|` in every added token.
    """
    known = json.loads(definition)
    listed = lambda part, name: (part or {}).get(name) or ([part] if part else [])
    normal, cut = listed(known.get("normalizer"), "normalizers"), listed(known.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
    split = cut[0] if cut else {}
    return (plain and any(n["type"] == "Lowercase" for n in normal) and split.get("type") == "Split" and split.get("pattern") == {"Regex": WORD_PATTERN}
            and split.get("behavior") == "Removed" and split.get("invert") is True
            and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in cut[1:])
            and all("<|" in t["content"] and len(t["content"].split()) == 1 for t in known.get("added_tokens") or [])
            and known["model"].get("end_of_word_suffix") == "</w>")


def for_letters(definition: str) -> Tokenizer:
    """The tokenizer for texts of LETTERS and spaces: the same model, without the steps that leave those as they are."""
    known = json.loads(definition)
    cut = known["pre_tokenizer"].get("pretokenizers") or [known["pre_tokenizer"]]
    known["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *cut[1:]]}
    return Tokenizer.from_str(json.dumps(known | {"normalizer": None, "post_processor": None, "added_tokens": []}))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first and end of each word in them, words before each text and in all).

    Words end at white space, and where ASCII letters or digits meet marks, which the pattern keeps apart;
    only an apostrophe may belong to what follows it. Capitals of ASCII are lower-cased. Texts that may
    hold special tokens are left as they stand.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    starts = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
    lower, alnum, mark = data - np.uint8(65) < 26, ALNUM[data], MARK[data]
    if not joined.isascii():
        lower[:-1] &= ~MAY_COMPOSE[data[1:]]
    cut = alnum[:-1] & mark[1:] | mark[:-1] & alnum[1:] & (data[:-1] != ord("'"))
    if b"<|" in joined:
        for k, text in enumerate(texts):
            if b"<|" in text:
                lower[starts[k]:starts[k + 1]] = cut[starts[k]:starts[k + 1]] = False
    inside = common.NOT_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut
    ends[:-1] &= ~inside[1:] | cut
    begin = np.flatnonzero(begins)
    return data | (lower.view(np.uint8) << np.uint8(5)), begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, starts)


def _keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) halves of words' keys, which only equal words share if they have at most KEY_BYTES.

    Longer words have a high half that no shorter one has.
    """
    padded, size = np.concatenate([data, np.zeros(16, np.uint8)]), end - begin
    wide = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    low = wide[begin] & _BYTES[np.minimum(size, 8)]
    high = wide[begin + np.minimum(size, 8)] & _BYTES[np.clip(size - 8, 0, 8)] | size.astype(np.uint64) << np.uint64(56)
    high[size > KEY_BYTES] = _BYTES[8]
    return low, high


def _slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return ((low ^ low >> np.uint64(32) ^ high * _MULTIPLIERS[0]) * _MULTIPLIERS[1] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class WordIds:
    """Ids of texts by a table of words met so far; the tokenizer encodes each new word once.

    This is for tokenizers of `goes_by_words`; with any other one whole texts are encoded. Strings of
    special tokens are left to the tokenizer as they stand. Slots name most words by their keys; long
    words, new ones, and those that lost their slot to another word are looked up one by one. When the
    table is full, words that came once are forgotten.
    """

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.by_words = goes_by_words(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends_word = np.zeros(self.size, bool)
        for token, k in vocabulary.items():
            self.ends_word[k] = token.endswith("</w>")
        if self.by_words:
            self.letters = for_letters(definition)
            # a long word with an id of its own stands between words whose ids are to be told apart
            whole = sorted((t[:-4] for t in vocabulary if t.endswith("</w>") and LETTERS.fullmatch(t[:-4].encode())), key=lambda t: (-len(t), t))
            alone = ((t, self.tokenizer.encode(t, add_special_tokens=False).ids) for t in whole)
            self.between, (self.between_id,) = next(((t.encode(), x) for t, x in alone if len(x) == 1), (None, [-1]))
        self.clear()

    def clear(self) -> None:
        self.known = _Places()
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first, self.count, self.uses = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.low, self.high, self.flat, self.used = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(4096, np.uint32), 0

    def _shrink(self) -> None:
        """Forget the words that came only once; all of them if that does not halve the table."""
        often = self.uses[:len(self.known)] > 1
        keep = np.flatnonzero(often)
        if len(keep) > KNOWN_WORDS // 2:
            return self.clear()
        words, ids = list(compress(self.known, often.tolist())), self._ids(keep)
        count, low, high = self.count[keep], self.low[keep], self.high[keep]
        self.clear()
        self.known.update(zip(words, range(len(words))))
        self._add(np.arange(len(words)), ids, np.cumsum(count))
        self._name(np.arange(len(words)), low, high, _slots(low, high))

    def _ids(self, places: np.ndarray) -> np.ndarray:
        lengths = self.count[places]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.first[places] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _grow(self) -> None:
        while len(self.first) < len(self.known):
            self.first, self.count, self.uses, self.low, self.high = (
                np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.first, self.count, self.uses, self.low, self.high))

    def _add(self, places: np.ndarray | list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of words of the table, one after the other, each up to its end."""
        self._grow()
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, self.flat])
        starts = np.concatenate([[0], ends[:-1]])
        self.first[places], self.count[places] = self.used + starts, ends - starts
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _name(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, slots: np.ndarray) -> None:
        """Keep the keys of words of the table; short words take their slots where these are free, the first word first."""
        self.low[places], self.high[places] = low, high
        free = np.flatnonzero((self.slots[slots] < 0) & (high != _BYTES[8]))[::-1]
        self.slots[slots[free]] = places[free]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of the last words of the table."""
        letters, rest = [], []
        for place, w in enumerate(words, old := len(self.known) - len(words)):
            (letters if LETTERS.fullmatch(w) else rest).append(place)
        for a in range(0, len(letters), 1024):
            own = letters[a:a + 1024]
            ids = np.array(self.letters.encode_batch_fast([b" ".join([words[k - old] for k in own]).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own):
                self._add(own, ids, ends)
            else:
                rest += own
        for a in range(0, len(rest), 1024):
            own = rest[a:a + 1024]
            parts = [words[k - old] for k in own]
            if self.between:
                text = b"".join([x for w in parts for x in (w, b" ", self.between, b" ")])
                ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.int64)
                at = ids == self.between_id
                if np.count_nonzero(at) == len(own):
                    self._add(own, ids[~at], np.flatnonzero(at) - np.arange(len(own)))
                    continue
            each = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in parts], add_special_tokens=False)]
            self._add(own, np.fromiter(chain.from_iterable(each), np.int64), np.cumsum([len(x) for x in each]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        if not self.by_words:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
        if len(self.known) > KNOWN_WORDS:
            self._shrink()
        data, begin, end, counts = _words(texts)
        low, high = _keys(data, begin, end)
        slots = _slots(low, high)
        at = self.slots[slots].astype(np.int64)
        miss = np.flatnonzero((at < 0) | (self.low[at] != low) | (self.high[at] != high))
        body = data.tobytes()
        words = [body[a:b] for a, b in zip(begin[miss].tolist(), end[miss].tolist())]
        old = len(self.known)
        at[miss] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
            new, where = np.unique(at[miss], return_index=True)
            where = miss[where[new >= old]]
            self._name(at[where], low[where], high[where], slots[where])
        self.uses[:len(self.known)] += np.bincount(at, minlength=len(self.known))
        ends = np.r_[0, np.cumsum(self.count[at])]
        return self._ids(at), ends[counts]


_ENCODERS: dict[int, WordIds] = {}


def _encoder(definition: str) -> WordIds:
    """The worker's encoder; the table of words serves all tasks the worker runs."""
    name = hash(definition)
    if name not in _ENCODERS:
        _ENCODERS[name] = WordIds(definition)
    return _ENCODERS[name]


def shards(rows: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, shard, ids, n_ids, payload) of ``rows`` (rank, key, text) in ascending order of rank."""
    spark = rows.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(definition.value), TaskContext.get().partitionId(), 0
        names: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        firsts: list[np.ndarray] = [np.zeros(1, np.int64)]
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal names, ids, firsts, held, number
            flat, first = np.concatenate(ids), np.concatenate(firsts)
            payload = repair.encode(flat, first, encoder.size, end_id)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([np.concatenate(names).astype("<i8").tobytes()]),
                 pa.array([len(flat) + len(first) - 1]), pa.array([payload])], ["part", "shard", "ids", "n_ids", "payload"])
            names, ids, firsts, held, number = [], [], [np.zeros(1, np.int64)], 0, number + 1
            return row

        for batch in batches:
            rank = batch.column(0).to_numpy()
            for row, end, data, offsets in common.text_blocks(batch.column(1), 1 << 20):
                body = data.tobytes()
                flat, first = encoder.encode([body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
                names.append(rank[row:end])
                ids.append(flat)
                firsts.append(first[1:] + held)
                held += len(flat)
                if held >= shard_ids:
                    yield shard()
        if names:
            yield shard()

    size = common.text_megabytes(rows)
    return (rows.select("rank", "text", "key").repartitionByRange(common.parts(spark, size, 48), "rank", "key")
            .sortWithinPartitions("rank", "key").select("rank", "text")
            .mapInArrow(work, "part int, shard int, ids binary, n_ids long, payload binary"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "shard", "rank", "before", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            shard, rank = repair.Shard.read(row["payload"]), np.frombuffer(row["ids"], "<i8")
            flat, first = shard.documents()
            data = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            n = len(rank)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(rank),
                 pa.array(first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], names)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> None:
    """Encode every whole text and write the files; null texts are empty, null ids come last."""
    shards(common.texts(docs, id_col, text_col), tokenizer, end_id).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, ids decoded from the shards."""
    files = spark.read.parquet(path)
    # ids before a shard: those of earlier parts (one row per part) and of earlier shards of its own part
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    own = Window.partitionBy("part").orderBy("shard")
    before = (files.select("part", "shard", "n_ids").join(by_part, "part")
              .select("part", "shard", (F.col("parts_before") + F.sum("n_ids").over(own) - F.col("n_ids")).alias("shards_before")))
    read = files.select("part", "shard", "ids", "payload").mapInArrow(
        _read, "part int, shard int, rank long, before long, n_tokens long, ids_crc32 long")
    return read.join(before, ["part", "shard"]).select(
        F.nullif(F.col("rank"), F.lit(common.NO_ID)).alias("doc_id"), (F.col("shards_before") + F.col("before")).alias("start"),
        "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files of ``docs`` and return what is read back from them (also the last pipeline stage)."""
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, default_tokenizer())
    common.release(spark)
    return read_token_files(spark, path)
