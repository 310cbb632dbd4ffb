"""BPE encoding and decoding by a dynamic program over prefixes.

For every prefix of a word there is exactly one token that ends its encoding. The tokens that are
suffixes of a prefix come from an automaton over the vocabulary (Aho-Corasick, whose suffix links play
the suffix automaton's part); of these, the one that is compatible with the token stored for the rest of
the prefix is stored for the prefix. The back-pointers from the end of the word give its ids. Two tokens
are compatible if no merge across their border would come before the merges that build them.

The vocabulary is one of ``tokenizers``' BPE files with word ends: its normaliser (NFC, lower case),
its split and its byte alphabet are restated here; files of another kind are refused. Words that were
seen before come from a table of bounded size.

``LibraryBpe`` differs in one step, for operators that are about what comes after the ids: the library's own model
merges a word that was not seen before.

Defined results: a null text counts as empty and has no ids; texts and words of any length are encoded
whole, in time linear in their length; ids of repeated rows are alike.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import add_by_block, hold, table

#: Words, and chunks between white space, kept with their ids in each Python worker (some 200 bytes each); chunks kept with
#: their decoded text, too; long ones are not kept.
CACHE_IDS, CACHE_BOTH, CACHE_LENGTH = 900_000, 500_000, 64

# Fixed values of the format: the white space of Unicode, and the split of the vocabulary file.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
CONTROLS, SPACES = re.compile("[\x1c-\x1f]"), re.compile(f"[{SPACE}]+")
#: Two tokens a, b are named by a * PAIR + b.
PAIR = 1 << 24
LENGTH_BITS = 8
#: Characters of a text that are taken before the tables are looked at again.
LONG_TEXT = 500_000
LENGTH = (1 << LENGTH_BITS) - 1
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: An end-of-word unit is its byte's character moved up by this.
END_SHIFT = 0x4000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is printable Latin-1, else the next from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


class WordBpe:
    """Encodes texts; made from the text of a vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != WORD_END or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT:
            raise ValueError("not a vocabulary with word ends of the known kind")
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special)) if self.special else ""
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.bytes = byte_characters()
        self.byte_table = dict(enumerate(self.bytes))
        self._take(source, vocab, model["merges"])
        # a chunk that is one normalised word and that word are one entry
        self.ids_of = _Table(CACHE_IDS, self._chunk_ids)
        self.both_of = _Table(CACHE_BOTH, lambda chunk: self._with_names(self._chunk_ids(chunk)))

    def _take(self, source: str, vocab: dict[str, int], merges: list) -> None:
        """Makes what encode_word needs."""
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges):
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.pair_rank[a, b] = rank
            self.parts.setdefault(made, (a, b, rank))
        # a match's value is its token and, in the low bits, its length
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, i in vocab.items():
            units = self._units(name)
            if i in self.parts or len(units) == 1:
                if len(units) >> LENGTH_BITS:
                    raise ValueError("a token is too long")
                self.automaton.add_word(units, i << LENGTH_BITS | len(units))
        self.automaton.make_automaton()
        self.right_edge = lru_cache(100_000)(lambda t: self._edge(t, 1))
        self.left_edge = lru_cache(100_000)(lambda t: self._edge(t, 0))
        self.fits = _Table(500_000, lambda pair: self._fits(*divmod(pair, PAIR)))

    @staticmethod
    def _units(name: str) -> str:
        if not name.endswith(WORD_END) or name == WORD_END:
            return name
        body = name[: -len(WORD_END)]
        return body[:-1] + chr(ord(body[-1]) + END_SHIFT)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of token while it is built, each with the rank of the merge that takes it in."""
        found, until = [], float("inf")
        while True:
            found.append((token, until))
            if token not in self.parts:
                return found
            until, token = self.parts[token][2], self.parts[token][side]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: no merge across the border comes before what takes its sides in."""
        for a, until_a in self.right_edge(left):
            for b, until_b in self.left_edge(right):
                rank = self.pair_rank.get((a, b))
                # of equal merges the leftmost comes first: the left side's own merge wins, the right side's loses
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def _byte_units(self, word: str) -> str:
        # the printable ASCII characters stand for themselves
        return word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.byte_table)

    def encode_word(self, word: str) -> bytes:
        """Ids of one split part, already normalised, as little-endian unsigned 32-bit integers."""
        units = self._byte_units(word)
        units = units[:-1] + chr(ord(units[-1]) + END_SHIFT)
        last = [0] * len(units)  # 0 is no match: its length would be 0
        fits = self.fits
        for end, match in self.automaton.iter(units):
            if not last[end]:
                size = match & LENGTH
                if size > end or (left := last[end - size]) and fits[(left >> LENGTH_BITS) * PAIR + (match >> LENGTH_BITS)]:
                    last[end] = match
        ids, at = [], len(units) - 1
        while at >= 0:
            match = last[at]
            ids.append(match >> LENGTH_BITS)
            at -= match & LENGTH
        ids.reverse()
        return packed(ids)

    def normalise(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower() alone makes a final sigma of a word's last capital sigma
        return text.replace("Σ", "σ").lower() if not text.isascii() else text.lower()

    def parts_of(self, chunk: str) -> list[str]:
        """The split parts of a text, normalised."""
        text = self.normalise(chunk)
        if text.isalpha():  # one run of letters
            return [text]
        if text[:-1].isalpha() and text[-1] in ",.;:!?":
            return [text[:-1], text[-1]]
        return self.words.findall(text)

    def _chunk_ids(self, chunk: str) -> bytes:
        parts = self.parts_of(chunk)
        if parts == [chunk]:
            return self.encode_word(chunk)
        return b"".join(map(self.ids_of.__getitem__, parts))

    def _with_names(self, ids: bytes) -> tuple[bytes, bytes]:
        return ids, " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())).encode()

    def _found(self, text: str, table: dict) -> list:
        """What ``table`` holds for the text's chunks between white space; a long text is taken in parts, so that tables stay bounded."""
        if len(text) > LONG_TEXT:
            out, start = [], 0
            while start < len(text):
                end = text.find(" ", start + LONG_TEXT)
                end = len(text) if end < 0 else end
                out += self._part(text[start:end], table)
                start = end + 1
            return out
        return self._part(text, table)

    def _part(self, text: str, table: dict) -> list:
        for t in (self.ids_of, table, self.fits):
            t.make_room()
        # str.split() also splits at four control characters that are no white space of Unicode
        return list(map(table.__getitem__, text.split() if not CONTROLS.search(text) else filter(None, SPACES.split(text))))

    def _pieces(self, text: str, table: dict, special) -> list:
        if not self.special_split or self.special_start not in text:
            return self._found(text, table)
        out = []
        for k, piece in enumerate(self.special_split.split(text)):
            out += [special(self.special[piece])] if k % 2 else self._found(piece, table)
        return out

    def encode_ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._pieces(text, self.ids_of, lambda i: np.array([i], "<u4").tobytes()))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The ids as in encode_ids, and the decoded text in UTF-8."""
        found = self._pieces(text, self.both_of, lambda i: self._with_names(np.array([i], "<u4").tobytes()))
        return b"".join([x[0] for x in found]), b" ".join([x[1] for x in found])


class LibraryBpe(WordBpe):
    """The same ids; words that are not in the table go through the merges of the ``tokenizers`` library."""

    def _take(self, source: str, vocab: dict[str, int], merges: list) -> None:
        from tokenizers import Tokenizer

        self.fits = _Table(0, None)
        self.merge = Tokenizer.from_str(source).model.tokenize

    def encode_word(self, word: str) -> bytes:
        return packed([t.id for t in self.merge(self._byte_units(word))])


class _Table(dict):
    """Values made on demand and kept for short keys; emptied before a text or word that finds it full."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make = most, make

    def __missing__(self, key):
        made = self.make(key)
        if key.__class__ is int or len(key) <= CACHE_LENGTH:
            self[key] = made
        return made

    def make_room(self) -> None:
        if len(self) > self.most:
            self.clear()


_MADE: dict[str, WordBpe] = {}


def loaded(source: str, most: int = CACHE_IDS, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """The encoder of a vocabulary file's text, with at most so many words kept; one in each Python process."""
    key = kind.__name__ + hashlib.md5(source.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = kind(source)
        hold("bpe", _MADE.clear)
    _MADE[key].ids_of.most = most
    return _MADE[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast text of a vocabulary file (a file of fixed size, about 2 MB)."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, text: str = "text", into: str = "bpe", path: str | None = None, keep: bool = True) -> DataFrame:
    """docs with a struct: n_tokens, hashes of ids and decoded text; with keep also ids (array) and decoded."""
    source = vocabulary(docs.sparkSession, path)

    def judge(texts: list[str]) -> list:
        bpe = loaded(source.value)
        made = [bpe.encode(t) for t in texts]
        out = [
            [len(ids) // 4 for ids, _ in made],
            [hashlib.sha256(ids).hexdigest() for ids, _ in made],
            [hashlib.sha256(names).hexdigest() for _, names in made],
        ]
        if keep:
            out += [[np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in made], [names.decode() for _, names in made]]
        return out

    return add_by_block(docs, text, into, SCHEMA + ", ids array<int>, decoded string" * keep, judge, holds="bpe")


def decode_ids(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the text of an array of ids: their tokens joined by spaces; null ids give null, an unknown id nothing."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    source = vocabulary(docs.sparkSession, path)

    @F.pandas_udf(T.StringType())
    def decode(column):
        names = loaded(source.value).names
        return column.map(lambda x: None if x is None else " ".join(names[i] for i in x if i in names))

    return docs.withColumn(into, decode(F.col(ids)))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, keep=False).select("doc_id", "bpe.*")
